from gridloom.functions import variants

ROWS = [(1, '{"k": 76, "s": "x"}'), (2, '{"k": "no"}'), (3, "{bad"), (4, None), (5, "[1,2]"), (6, '{"k": null, "n": {"d": [1.5]}}'), (7, "")]


def test_fields_by_path_and_type(spark):
    v = variants.parsed(spark.createDataFrame(ROWS, "id int, p string"), "p")
    got = variants.extracted(v, "p", {"k": ("$.k", "int"), "word": ("$.k", "string"), "d": ("$.n.d[0]", "double"), "day": ("$.s", "date"), "none": ("$.x.y", "string")})
    rows = {r["id"]: (r["k"], r["word"], r["d"], r["day"], r["none"]) for r in got.orderBy("id").collect()}
    assert rows[1] == (76, "76", None, None, None) and rows[2] == (None, "no", None, None, None) and rows[6] == (None, None, 1.5, None, None)
    assert all(rows[i] == (None,) * 5 for i in (3, 4, 5, 7))


def test_schemas_are_found(spark):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("a", '{"k": 2, "s": "x"}'), ("b", '{"k": "y"}'), ("c", None)], "g string, p string")
    got = {r["g"]: r["schema"] for r in variants.discovered(variants.parsed(df, "p"), "p", ("g",)).collect()}
    assert got["a"] == "OBJECT<k: BIGINT, s: STRING>" and got["b"] == "OBJECT<k: STRING>" and got["c"] == "VOID"
    flat = variants.flattened(variants.parsed(spark.createDataFrame(ROWS, "id int, p string"), "p"), "p", "id")
    assert sorted((r["id"], r["path"], r["kind"]) for r in flat.collect())[:3] == [(1, "k", "BIGINT"), (1, "s", "STRING"), (2, "k", "STRING")]
