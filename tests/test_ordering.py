"""Places and running sums over groups of any size, with nulls, ties and repeated rows."""

import random

from pyspark.sql import functions as F

from loomframe.operators.ordering import places, running_totals


def test_places_and_totals(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.randrange(10**12)]), r.randrange(9)) for _ in range(3000)]
    rows += [("solo", 5, 1)] + [("hot", k * 1_000_003, 2) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = running_totals(places(df, ["g"], ["o", "v"], total="n"), ["g"], "place", {"before": F.col("v"), "rows": F.lit(1)}, width=64).collect()
    assert len(got) == len(rows)
    for g in {x[0] for x in rows}:
        own = sorted(((x[1] is not None, x[1] or 0, x[2]) for x in rows if x[0] == g))
        mine = sorted((x for x in got if x.g == g), key=lambda x: x.place)
        assert [(x.o is not None, x.o or 0, x.v) for x in mine] == own
        assert [x.place for x in mine] == list(range(len(own))) == [x.rows for x in mine] and {x.n for x in mine} == {len(own)}
        assert [x.before for x in mine] == [sum(y[2] for y in own[:k]) for k in range(len(own))]
    whole = places(df, [], [F.desc("v"), "g", "o"]).collect()
    assert [x.v for x in sorted(whole, key=lambda x: x.place)] == sorted((x[2] for x in rows), reverse=True)
    assert places(df.limit(0), ["g"], ["o"], total="n").collect() == []
