"""The queries on the smallest tables against their SQL, and the registration."""

import pytest

SF = "/root/testdata/sf0.001"


def test_registered_and_importable():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_recompression", "op2_pivot_topk", "op4_legacy_archives", "op6_suffix_automaton",
                                  "op8_chosen_path", "op11_fill_in_middle", "op12_reversed_search"])
def test_equals_its_sql(spark, name):
    import oracle
    from trackspark.llm.oracles import ORACLE_SQL
    from trackspark.llm.queries import QUERIES
    con = oracle.connect(SF)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert oracle.canonical(df.columns, [tuple(r) for r in df.collect()]) == oracle.canonical(names, cursor.fetchall())
