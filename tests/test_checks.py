"""Queries against their checking SQL on the smallest tables.

A sample across all parts runs by default; PAIRLENS_ALL=1 runs every query.
"""

import os

import pytest

import check
from pairlens.catalog import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = """
pf04_canonical_condition pf06_unknown_values pf15_drop_nonfinite pf19_pairwise_preference pf25_load_items
io01_read_csv io03_read_jsonl io05_scan_runs io12_run_partitioned s04_read_scores
j03_join_many_to_one j09_edit_neighbors j11_has_association j14_assign_opposite
ag02_summarize_measures ag03_standard_summaries ag05_baseline_vs_primed ag12_condition_contrasts
ag19_region_report ag38_strict_audit ag45_review_coverage
w01_counterbalance w04_baseline_shift w09_seeded_pick w10_rotating_pick sl05_sample_items
rs05_to_wide rs09_to_long_by_pattern rs10_prompts_to_rows
tx03_sentence_key tx16_to_ing tx18_verb_key tx23_label_structure tx25_binary_class tx28_normalize_answer
tx31_review_queue tx32_render_prompts tx42_build_items s02_build_requests
ar04_location_metrics ar07_align_tokens ar11_item_pe ar16_category_predictability ar19_cosine_topk
st01_paired_effect st02_paired_effect_long st06_one_sample st07_paired_tests st08_bootstrap_poisson
st08_bootstrap_exact st09_sign_flip st11_mcnemar st15_ols_hc3_simple st17_binomial_glm st25_contrast
s01_ngram_score_unseen s03_assemble_scores
""".split()
NAMES = list(QUERIES) if os.environ.get("PAIRLENS_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    result, _ = check.compare(spark, con, SF, name)
    assert result.startswith(("ok", "rows only")), result


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
