"""The dataset's queries cover every partition and pattern."""

from morphlake import catalog
from morphlake.operators import dataset
from morphlake.operators.patterns import PARTITIONS, PATTERNS


def test_candidates_cover_all_patterns(spark):
    found = catalog.QUERIES["dataset_candidates"](spark, "").select("global_index", "partition", "graph_signature").collect()
    assert {r.global_index for r in found} == set(range(dataset.CANDIDATES)) and len(found) == dataset.CANDIDATES
    assert {r.partition for r in found} == set(PARTITIONS) and {r.graph_signature for r in found} == set(PATTERNS)


def test_scored_rows_are_the_split(spark):
    assert sum(r["rows"] for r in catalog.QUERIES["score_classes"](spark, "").collect()) == dataset.SPLITS["grpo"][2]


def test_no_candidate_has_a_fault(spark):
    assert catalog.QUERIES["dataset_faults"](spark, "").isEmpty()
