"""Bands of delimited files, and shares of parts on hand-made cases."""

from pyspark.sql import functions as F

from paperlume.operators import upkeep
from paperlume.sources import delimited


def test_bands(spark, tmp_path):
    body = "".join(f'{k},"say ""{k}"", or\nnot"\n' for k in range(85))
    (tmp_path / "a.csv").write_text("id,note\n" + body + ",\n")
    (tmp_path / "b.csv").write_text("id,note\n7,x\n")
    (tmp_path / "c.csv").write_text("id,note\n")
    found = {(r["file"].rsplit("/", 1)[-1], r["band"]): (r["n_rows"], r["text"]) for r in delimited.read_bands(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in found.items()} == {("a.csv", 0): 40, ("a.csv", 1): 40, ("a.csv", 2): 5, ("b.csv", 0): 1}
    assert found["b.csv", 0][1] == "id\tnote\n7\tx"
    assert found["a.csv", 2][1] == "id\tnote\n" + "\n".join(f'{k}\tsay "{k}", or\nnot' for k in range(80, 85))


def test_shares(spark):
    rows = spark.createDataFrame([(3, 1, 5), (5, 1, 5), (0, 0, 0)], "parsed long, blank long, declared long")
    found = rows.select(upkeep.fidelity(F.col("parsed"), F.col("blank"), F.col("declared")), upkeep.parity(F.col("blank"), F.col("parsed"))).collect()
    assert [tuple(r) for r in found] == [(0.8, 1 / 3), (1.0, 0.2), (None, None)]


def test_leaks(spark):
    rows = spark.createDataFrame([("The SECRET word",), ("nothing",), (None,)], "text string")
    assert [r[0] for r in rows.select(upkeep.leaks(F.col("text"), ["secret"])).collect()] == [True, False, False]
