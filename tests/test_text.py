import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (X.canonical_id, {"Google, Inc.": "google_inc", "DeepMind-Technologies": "deepmindtechnologies", "  Élan  Vital ½ ": "élan_vital_½", "a_b": "a_b"}),
        (X.relation_type, {"founded by": "FOUNDED_BY", " works-at! ": "WORKS_AT", "123": "RELATED_TO", "": "RELATED_TO"}),
        (X.label, {"ORGANIZATION": "Organization", "MACHINE_LEARNING": "Machinelearning", "--": "Concept"}),
        (X.normalize, {"SG cyber-security": "smart grid cyber security", "TCBRs": "tcbr", "SGs": "sgs", "sg": "smart grid", "policies": "policy", "class": "class", "destabilises": "destabilize", "bus": "bus", "lines": "line"}),
        (X.category, {"is-a": X.HIERARCHICAL, "type of": X.HIERARCHICAL, "causes": X.CAUSAL, "mitigates": X.CAUSAL, "includes": X.RELATIONAL, "turn-to": X.RELATIONAL, "has_component": X.OTHER, "are": X.HIERARCHICAL}),
        (X.token_count, {"is-a": 2, "": 1, "causes": 1, "_lead to": 3}),
        (X.dehyphenate, {"exam-\nple  a\tb\nc": "example a b\nc"}),
        (X.model_name, {"flash": "gemini-2.5-flash", "models/gemini-x": "gemini-x", " pro ": "gemini-2.5-pro", "9": "gemini-9"}),
        (X.number_word, {"Seven": 7, "many": None}),
        (X.yes_no, {"yes": 1, "No": 0, "?": None}),
    ],
)
def test_rules(spark, f, cases):
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_normalising_twice_differs(spark):
    assert apply(spark, lambda c: X.normalize(X.normalize(c)), ["TCBRs"]) == ["thyristor controlled braking resistor"]
