import json

from pyspark.sql import functions as F

from anomalens.operators import calls as C

XML = ("<tool_call>\n<function=execute_sql>\n<parameter=sql>\nFROM stock\nSELECT depot, max(kg)\n GROUP BY depot\n"
       "</parameter>\n<parameter=purpose>\nheaviest load per depot (仓库)\n</parameter>\n</function>\n</tool_call>")
XML_ARGS = {"sql": "FROM stock\nSELECT depot, max(kg)\n GROUP BY depot", "purpose": "heaviest load per depot (仓库)"}


def wrap(name, **params):
    body = "".join(f"<parameter={k}>\n{v}\n</parameter>\n" for k, v in params.items())
    return f"<tool_call>\n<function={name}>\n{body}</function>\n</tool_call>"


FINDING = [{"claim": "库存 ran out", "value": 17.5, "evidence_sql": "FROM stock"}]

# text -> (calls as (name, arguments, malformed), thinking, plain, warnings)
CASES = [
    (XML, [("execute_sql", XML_ARGS, False)], None, "", []),
    (wrap("final_answer", key_findings=json.dumps(FINDING, ensure_ascii=False)),
     [("final_answer", {"key_findings": FINDING}, False)], None, "", []),
    (wrap("final_answer", key_findings=repr(FINDING)),
     [("final_answer", {"key_findings": FINDING}, False)], None, "", []),
    (wrap("f", a=42, b=0.75, c="true", d=-3), [("f", {"a": 42, "b": 0.75, "c": True, "d": -3}, False)], None, "", []),
    ("<tool_call><function=f><parameter=a>1</parameter><parameter=a>2</parameter></function>"
     "<function=查询工具></function></tool_call>", [("f", {"a": 2}, False), ("查询工具", {}, False)], None, "", []),
    ('<tool_call>{"name": "execute_sql", "arguments": {"sql": "TABLE depots"}}</tool_call>',
     [("execute_sql", {"sql": "TABLE depots"}, False)], None, "", []),
    ('<tool_call>{"name": "f", "arguments": "{\\"x\\": 1}"}</tool_call>', [("f", {"x": 1}, False)], None, "", []),
    ('<tool_call>```json {"name": "", "tool": "g", "arguments": {}, "parameters": {"y": 2}} ```</tool_call>',
     [("g", {"y": 2}, False)], None, "", []),
    ("<think>which depot, 哪个</think>\nhere: " + XML, [("execute_sql", XML_ARGS, False)], "which depot, 哪个", "here:", []),
    ("<think>never closed", [], None, "", []),
    ("<|im_end|>" + XML + "<|im_end|>", [("execute_sql", XML_ARGS, False)], None, "", []),
    ("", [], None, "", []),
    (None, [], None, "", ["null_output"]),
    ("The depot flooded, 所以空了.", [], None, "The depot flooded, 所以空了.", []),
    ('<tool_call>{"tool": f(1)}</tool_call>', [("", {}, True)], None, "", []),
    ("Next I would run execute_sql on stock.", [], None, "Next I would run execute_sql on stock.",
     ["tool_without_call: execute_sql"]),
    ('<tool_call>{"name": "old", "name": "g", "arguments": {"sql": "a", "sql": "b", "n": NaN}}</tool_call>',
     [("g", {"sql": "b", "n": "NaN"}, False)], None, "", []),
    ("<tool_call>" + "long " * 40 + "</tool_call>", [], None, "", ["unparsable_block: " + ("long " * 40).strip()]),
    ("<tool_call>\n<function=execute_sql>\n<parameter=sql>TABLE depots</parameter>",
     [("execute_sql", {"sql": "TABLE depots"}, False)], None, "", ["unclosed_call"]),
    (XML + "\n" + XML, [("execute_sql", XML_ARGS, False)] * 2, None, "", []),
    ("<tool_call> </tool_call> x <tool_call>hi</tool_call>", [], None, "x", ["empty_block", "unparsable_block: hi"]),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    out = C.extract_calls(df).withColumn("json", F.transform("calls", lambda c: F.to_json(c["arguments"])))
    rows = {r.i: r for r in out.drop("text").withColumn("calls", F.transform(
        "calls", lambda c: F.struct(c["name"].alias("name"), c["malformed"].alias("malformed")))).collect()}
    for i, (_, calls, thinking, plain, warnings) in enumerate(CASES):
        r = rows[i]
        got = [(c.name, json.loads(a), c.malformed) for c, a in zip(r.calls, r.json)]
        assert (got, r.thinking, r.plain, r.warnings) == (calls, thinking, plain, warnings), i


def test_first_call_and_outcome(spark):
    texts = [XML + XML, "hm", '<tool_call>{"x"}</tool_call>', wrap("nope", x=1)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = C.first_call(C.extract_calls(df)).select("i", C.call_outcome(F.col("call")).alias("o"), "extra_calls")
    assert [tuple(r)[1:] for r in out.orderBy("i").collect()] == [
        ("dispatched", 1), ("no_call", 0), ("malformed_call", 0), ("unknown_tool", 0)]


def test_answer_check(spark):
    base = {"diagnosis": "d", "root_cause_dimension": "r"}
    ok = {"claim": "c", "value": None}
    cases = [({**base, "key_findings": [ok]}, ("ok", None, None)),
             ({"diagnosis": "", "root_cause_dimension": "r"}, ("missing_fields", ["diagnosis", "key_findings"], None)),
             ({**base, "key_findings": [ok, {"claim": "c"}]}, ("bad_finding", None, 1)),
             ({**base, "key_findings": "abc"}, ("bad_finding", None, 0)),
             ({**base, "key_findings": 5}, ("bad_arguments", None, None)),
             ({**base, "key_findings": [ok], "confidence": "x"}, ("tool_internal_error", None, None)),
             ({**base, "key_findings": [ok], "confidence": 0.5}, ("ok", None, None))]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, a string")
    out = df.select("i", C.check_answer(F.parse_json("a")).alias("c")).orderBy("i").collect()
    assert [tuple(r.c) for r in out] == [c[1] for c in cases]
