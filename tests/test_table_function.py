"""The table function beside the scan of whole texts."""

from leakscan_spark.functions.rules import BUILTIN_RULES, Rule
from leakscan_spark.operators.scan import scan_texts
from leakscan_spark.operators.table_function import register_scan_function


def test_same_rows_as_the_scan(spark):
    rules = [*BUILTIN_RULES, Rule("No literal", "[0-9]{9}", "low"), Rule("Lines", "end\nstart"), Rule("Folded", "(?i)tok-[a-z]+"), Rule("Broken", "(")]
    rows = [
        ("a", "AKIA" + "Q" * 16 + " and ghp_" + "a1" * 18), ("b", None), ("c", ""), ("d", 'api_key = "MY_KEY_NAME_NOW"\napi_key = "abcd1234abcd1234"'),
        ("e", "123456789 end\nstart"), ("f", "TOK-AB tok-c"), ("g", "nothing"),
    ]
    texts = spark.createDataFrame(rows, "file string, text string")
    texts.createOrReplaceTempView("udtf_texts")
    register_scan_function(spark, rules, "scan_some")
    got = spark.sql("SELECT t.file, f.rule, f.severity, f.match, f.rule_ord FROM udtf_texts t, LATERAL scan_some(t.text) f").collect()
    want = scan_texts(texts, rules).select("file", "rule", "severity", "match", "rule_ord").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7
    counted = spark.sql("SELECT f.severity, count(*) AS n FROM udtf_texts t, LATERAL scan_some(t.text) f GROUP BY 1").collect()
    assert sum(r.n for r in counted) == 7


def test_no_arrow_batch_per_text(spark):
    register_scan_function(spark, BUILTIN_RULES, "scan_plain")
    spark.range(3).selectExpr("concat('AKIA', repeat('Q', 16)) AS text").createOrReplaceTempView("udtf_plain")
    plan = spark.sql("SELECT f.match FROM udtf_plain t, LATERAL scan_plain(t.text) f")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
