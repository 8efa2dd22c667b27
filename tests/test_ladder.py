from pyspark.sql import functions as F

from fieldscore.operators.ladder import strict_ladder


def test_all_five_levels(spark):
    rows = [("text", "Abc", "Abc"), ("text", "ABC", "abc"), ("numeric", "1,234.50", "1234.5"), ("date_iso", "2024-03-05", "5 March 2024"), ("phone", "+1 (555) 010-2030", "+1 555 010 2030"), ("address", "x", "y"), ("text", "x", "__ABSENT__")]
    v = spark.createDataFrame([("FINAL", *r) for r in rows], "arm string, rule string, p string, truth string").withColumn("pred", F.parse_json(F.to_json(F.struct(F.col("p").alias("originalValue")))))
    got = {r.level: (r.n, r.n_ok) for r in strict_ladder(v).collect()}
    assert got == {"L0": (5, 1), "L1": (5, 2), "L2": (5, 3), "L3": (5, 4), "L4": (5, 5)}
