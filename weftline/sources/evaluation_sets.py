"""Published evaluation sets for one abstract: gold triples and four systems' predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schema import TRIPLES

# Gold triples, in their order (matching depends on it).
GOLD = [
    ("conventional power system", "turn-to", "smart grid"),
    ("SG cyber security", "is-a", "critical issue"),
    ("interconnection of several load", "causes", "critical issue"),
    ("generator", "causes", "critical issue"),
    ("renewable resource", "causes", "critical issue"),
    ("cyber-physical attack", "skos:broader", "threatening of SGs security"),
    ("cyber-physical attack", "causes", "blackout"),
    ("cyber-physical attack", "causes", "destruction of infrastructure"),
    ("cyber-physical attack", "includes", "cyber switching attack"),
    ("cyber-physical attack", "have", "severity"),
    ("cyber switching attack", "destabilise", "smart grid"),
    ("Thyristor-Controlled Braking Resistor", "mitigate", "attack"),
    ("Thyristor-Controlled Braking Resistor", "stabilize", "target generator"),
    ("large blackout", "is-a", "severe consequence"),
    ("destruction of infrastructures", "is-a", "severe consequence"),
]
# The systems' predicted triples, in their order.
PREDICTED = {
    "LLMGraphTransformer (Gemini 2.5 Flash)": [
        ("conventional power system", "turn-to", "smart grid"),
        ("cyber-physical attack", "skos:broader", "threatening of SGs security"),
        ("cyber-physical attack", "causes", "blackout"),
        ("cyber-physical attack", "causes", "destruction of infrastructure"),
        ("cyber-physical attack", "includes", "cyber switching attack"),
        ("cyber switching attack", "destabilise", "smart grid"),
        ("Thyristor-Controlled Braking Resistor", "mitigate", "attack"),
        ("Thyristor-Controlled Braking Resistor", "stabilize", "target generator"),
        ("smart grid", "has_component", "generator"),
        ("renewable resource", "integrated_into", "power grid"),
        ("cyber security", "protects", "infrastructure"),
        ("braking resistor", "controls", "power swing"),
        ("attack", "targets", "SCADA system"),
        ("switching attack", "manipulates", "circuit breaker"),
        ("power system", "experiences", "transient instability"),
        ("security issue", "impacts", "reliability"),
        ("target generator", "connected_to", "bus"),
    ],
    "KGGen (Gemini 2.5 Flash)": [
        ("cyber-physical attack", "skos:broader", "threatening of SGs security"),
        ("cyber-physical attack", "causes", "blackout"),
        ("cyber-physical attack", "causes", "destruction of infrastructure"),
        ("cyber switching attack", "destabilise", "smart grid"),
        ("Thyristor-Controlled Braking Resistor", "mitigate", "attack"),
        ("Thyristor-Controlled Braking Resistor", "stabilize", "target generator"),
        ("smart grid", "faces", "cyber threat"),
        ("interconnection", "creates", "vulnerability"),
        ("load", "draws", "power"),
        ("generator", "supplies", "grid"),
        ("severity", "measured_by", "consequence"),
        ("braking resistor", "is_device", "FACTS"),
        ("consequence", "includes", "infrastructure damage"),
        ("attack", "causes", "damage"),
        ("stabilize", "applied_to", "generator"),
    ],
    "KGGen (Gemini Pro)": [
        ("conventional power system", "turn-to", "smart grid"),
        ("cyber-physical attack", "skos:broader", "threatening of SGs security"),
        ("cyber-physical attack", "includes", "cyber switching attack"),
        ("cyber switching attack", "destabilise", "smart grid"),
        ("Thyristor-Controlled Braking Resistor", "mitigate", "attack"),
        ("Thyristor-Controlled Braking Resistor", "stabilize", "target generator"),
        ("large blackout", "is-a", "severe consequence"),
        ("smart grid", "requires", "cyber security"),
        ("renewable resource", "causes", "fluctuation"),
        ("cyber attack", "leads_to", "blackout"),
        ("braking resistor", "provides", "damping"),
        ("switching attack", "causes", "instability"),
        ("threat", "affects", "power grid"),
    ],
    "G-T2KG (GPT-4 OpenIE+Validation)": [
        ("SG cyber security", "is-a", "critical issue"),
        ("cyber-physical attack", "have", "severity"),
        ("Thyristor-Controlled Braking Resistor", "stabilize", "target generator"),
        ("large blackout", "is-a", "severe consequence"),
        ("conventional power system", "transition_towards", "smart grid"),
        ("interconnection of loads", "is_factor_in", "security"),
        ("destruction of infrastructures", "is-a", "severe consequence"),
    ],
}


def predictions(spark: SparkSession) -> DataFrame:
    rows = [(run, i, *t) for run, ts in PREDICTED.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, TRIPLES)


def gold(spark: SparkSession) -> DataFrame:
    """The gold triples, once for each run."""
    rows = [(run, i, *t) for run in PREDICTED for i, t in enumerate(GOLD)]
    return spark.createDataFrame(rows, TRIPLES)


def answered_triples(answers: DataFrame, *, keep_empty: bool = False) -> DataFrame:
    """Triples of JSON answers (run, answer): empty parts drop a triple before white space is stripped."""
    from weftline.functions import text as X
    from weftline.schema import TRIPLES_ANSWER

    t = answers.select("run", F.posexplode(F.from_json("answer", TRIPLES_ANSWER)["triples"]).alias("idx", "t")).select("run", "idx", "t.*")
    if not keep_empty:
        t = t.where((F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != ""))
    return t.select("run", "idx", X.strip(F.col("subject")).alias("subject"), F.lower(X.strip(F.col("predicate"))).alias("predicate"), X.strip(F.col("object")).alias("object"))
