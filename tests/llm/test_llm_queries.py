import pytest

from chronoloom.llm.queries import QUERIES, SQL
from tests.sqlcheck import assert_same

# What holds for the queries that SQL cannot express
PROPERTIES = {
    "p1_distance_percentiles": lambda rows: rows and all(r.rank_error <= r.error_bound and r.n_below <= r.n_upto <= r.n for r in rows),
    "p5_neighbours": lambda rows: rows and all(r.row_id % 100 == 0 and 1 <= r["rank"] <= 10 and r.distance >= 0 for r in rows),
    "p6_packed": lambda rows: rows and all(0 <= r.tokens <= r.bin_tokens <= r.capacity_tokens for r in rows),
    "p6_report": lambda rows: len(rows) == 3 and all(r.least_containers <= r.containers <= r.least_containers + 1 for r in rows),
    "p7_mixed": lambda rows: rows and all(1 <= r.copies <= r.max_repeats for r in rows),
    "p7_shares": lambda rows: abs(sum(r.reached_share for r in rows) - 1) < 1e-9 and all(r.most_copies <= r.max_repeats for r in rows),
    "p7_demanded": lambda rows: all(0 < r.exponent <= 1 for r in rows) and all(r.most_copies <= r.max_repeats for r in rows),
    "p7_entropy": lambda rows: len({r.exponent for r in rows}) == 1 and abs(sum(r.weight for r in rows) - 1) < 1e-9,
    "p8_found": lambda rows: rows and len({r.doc_id for r in rows}) == len(rows),
    "p8_classes": lambda rows: all(r.class_id <= r.doc_id and r.residue == (r.reason is not None) for r in rows),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert_same(df, SQL[name], folder)
    else:
        assert PROPERTIES[name](df.collect())
