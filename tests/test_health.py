from fractions import Fraction

from partloom.operators import risk
from pyspark.sql import functions as F


def test_health_is_exact_at_ties(spark):
    """a mean that ends in half a tenth goes up, however its lines are added."""
    used = [k for k in risk.FACTORS if k != "cost"]
    ties = [[(49.6, 21.0), (100.0, 14.0), (46.0, 37.0)], [(68.0, 45.0), (6.4, 22.0), (15.7, 47.0)], [(100.0, 8.0), (49.6, 14.0), (46.0, 26.0)], [(49.6, 2.0), (30.4, 11.0), (100.0, 35.0)], [(6.4, 17.0), (16.0, 2.0), (49.6, 13.0)], [(100.0, 34.0), (38.0, 13.0), (46.0, 33.0)]]
    rows = [(b, w, *[f] * len(used)) for b, pairs in enumerate(ties) for f, w in pairs]
    scored = spark.createDataFrame(rows, "bom_id long, quantity double, " + ", ".join(f"f_{k} double" for k in used))
    scored = scored.withColumns({"dnp": F.lit(False), "lifecycle": F.lit("Active"), "stock": F.lit(1), "kind": F.lit("exact"), "rohs": F.lit("Compliant")})
    got = {r["bom_id"]: r for r in risk.health(scored).collect()}
    wrong = []
    for b, r in got.items():
        mine = [x for x in rows if x[0] == b]
        for i, k in enumerate(used):
            mean = sum(Fraction(round(x[2 + i] * 1000), 1000) * Fraction(x[1]) for x in mine) / sum(Fraction(x[1]) for x in mine)
            want = ((100 - mean) * 10 + Fraction(1, 2)).__floor__() / 10
            if r[k] != want:
                wrong.append((b, k, r[k], want))
    assert not wrong
