"""The folded chains hold what the secondary structure's SQL is to be tried on."""

from trajix.plans import oracle, queries


def test_every_code_occurs(spark, tables):
    found = queries.QUERIES["dssp_folded_content"](spark, tables)
    assert {r["code"] for r in found.select("code").distinct().collect()} == set(" HBEGIPTS")


def test_sheets_ladders_and_bulges_occur(duck):
    sql = oracle.ORACLE_SQL["dssp_folded"]
    begin = sql[: sql.rindex("SELECT frame, residue AS residue_index")].rstrip()
    assert {x[0] for x in duck.execute(f"{begin} SELECT DISTINCT par FROM la").fetchall()} == {True, False}
    bulges, most, joined = duck.execute(f"{begin} SELECT count(*) FILTER (i1 - i0 + 1 > n OR j1 - j0 + 1 > n), max(x), (SELECT count(*) FROM la) - count(*) FROM lad").fetchone()
    assert bulges > 20 and most > 2 and joined > 20
    assert duck.execute(f"{begin} SELECT max(sheet) FROM sh").fetchone()[0] > 1


def test_an_incomplete_residue_has_no_code(spark, tables):
    lost = queries.QUERIES["dssp_folded_every_residue"](spark, tables).exceptAll(queries.QUERIES["dssp_folded"](spark, tables).select("frame", "residue_index", "code"))
    assert {(r["residue_index"], r["code"]) for r in lost.select("residue_index", "code").distinct().collect()} == {(43, " ")}
