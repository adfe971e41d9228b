"""Text rules as column functions, each with the DuckDB expression of the same rule.

`\\w` and `\\s` are spelled as Unicode classes, since engines differ on what the
short forms cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations, spelling variants and predicate key words of the domain.
ABBREVIATIONS = {"sg": "smart grid", "tcbr": "thyristor controlled braking resistor", "cps": "cyber physical system"}
SPELLINGS = {"destabilise": "destabilize", "destabilises": "destabilize", "destabilizes": "destabilize", "stabilise": "stabilize", "stabilises": "stabilize", "stabilizes": "stabilize"}
HIERARCHICAL = "Hierarchical / Definitional"
CAUSAL = "Causal & Functional"
RELATIONAL = "Relational & Structural"
OTHER = "Other"
CATEGORIES = (HIERARCHICAL, CAUSAL, RELATIONAL, OTHER)
COPULAS = ("is", "is_a", "isa", "are")
STEMS = {
    HIERARCHICAL: ("is_a", "subclass", "broader", "type_of", "skos", "category"),
    CAUSAL: ("cause", "mitigat", "stabiliz", "destabiliz", "lead_to", "result", "trigger", "prevent", "impact"),
    RELATIONAL: ("include", "have", "turn_to", "transform", "part_of", "use", "contain"),
}


def strip(c: Column) -> Column:
    """White space of all kinds off both ends (`trim` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_sql(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def canonical_id(name: Column) -> Column:
    """Lower case, punctuation (hyphens too) deleted, white space runs to one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(name)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", "_")


def canonical_id_sql(e: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({strip_sql(e)}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', '_', 'g')"


def relation_type(rel: Column) -> Column:
    """Upper snake case; RELATED_TO where nothing that starts with a letter is left."""
    c = F.regexp_replace(F.regexp_replace(F.upper(strip(rel)), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(c.rlike("^[A-Za-z]"), c).otherwise("RELATED_TO")


def relation_type_sql(e: str) -> str:
    c = f"regexp_replace(regexp_replace(upper({strip_sql(e)}), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN regexp_matches({c}, '^[A-Za-z]') THEN {c} ELSE 'RELATED_TO' END"


def label(kind: Column) -> Column:
    """Letters and digits only, the first upper and the rest lower case; Concept if none."""
    c = F.regexp_replace(kind, "[^A-Za-z0-9]+", "")
    return F.when(c != "", F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))).otherwise("Concept")


def label_sql(e: str) -> str:
    c = f"regexp_replace({e}, '[^A-Za-z0-9]+', '', 'g')"
    return f"CASE WHEN {c} <> '' THEN upper({c}[1:1]) || lower({c}[2:]) ELSE 'Concept' END"


def _mapped(token: Column, table: dict[str, str]) -> Column:
    pairs = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for kv in table.items() for x in kv)
    return F.coalesce(F.element_at(F.expr(f"map({pairs})"), token), token)


def _singular(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("s") & ~t.endswith("ss") & (n > 3), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def tokens(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[-_]", " "), r"[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: t != "")


def normalize(text: Column) -> Column:
    """Tokens with abbreviations expanded, spellings unified and plurals cut, joined by blanks."""
    return F.array_join(F.transform(tokens(text), lambda t: _singular(_mapped(_mapped(t, ABBREVIATIONS), SPELLINGS))), " ")


def normalize_sql(e: str) -> str:
    cleaned = rf"regexp_replace(regexp_replace(lower({strip_sql(e)}), '[-_]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
    cases = lambda t: "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.items()) + " ELSE t END"
    plural = "CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN t[1:length(t) - 3] || 'y' WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN t[1:length(t) - 1] ELSE t END"
    found = rf"list_filter(string_split_regex({cleaned}, '\s+'), lambda t: t <> '')"
    return f"array_to_string(list_transform(list_transform(list_transform({found}, lambda t: {cases(ABBREVIATIONS)}), lambda t: {cases(SPELLINGS)}), lambda t: {plural}), ' ')"


def category(predicate: Column) -> Column:
    """Of a predicate: the first category one of whose stems stands in its plain or normalised form."""
    plain = F.regexp_replace(F.lower(strip(predicate)), "[ -]", "_")
    norm = F.replace(normalize(predicate), F.lit(" "), F.lit("_"))

    def told(forms: Column) -> Column:
        has = lambda stems: F.exists(forms, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(s)) for s in stems]))
        out = F.when(F.exists(forms, lambda x: x.isin(*COPULAS)) | has(STEMS[HIERARCHICAL]), HIERARCHICAL)
        return out.when(has(STEMS[CAUSAL]), CAUSAL).when(has(STEMS[RELATIONAL]), RELATIONAL).otherwise(OTHER)

    # bound once by the lambda: the forms stand in the plan a single time, not once per stem
    return F.transform(F.array(F.array(plain, norm)), told)[0]


def category_sql(e: str) -> str:
    plain = f"regexp_replace(lower({strip_sql(e)}), '[ -]', '_', 'g')"
    norm = f"replace({normalize_sql(e)}, ' ', '_')"
    has = lambda stems: " OR ".join(f"contains({x}, '{s}')" for s in stems for x in (plain, norm))
    copulas = ", ".join(f"'{c}'" for c in COPULAS)
    return f"CASE WHEN {plain} IN ({copulas}) OR {norm} IN ({copulas}) OR {has(STEMS[HIERARCHICAL])} THEN '{HIERARCHICAL}' WHEN {has(STEMS[CAUSAL])} THEN '{CAUSAL}' WHEN {has(STEMS[RELATIONAL])} THEN '{RELATIONAL}' ELSE '{OTHER}' END"


def token_count(predicate: Column) -> Column:
    """Parts between blanks, underscores and hyphens; an empty text is one, a leading separator adds one."""
    return F.size(F.split(strip(predicate), r"[\s_\-]+", -1)).cast("long")


def token_count_sql(e: str) -> str:
    return rf"CAST(len(string_split_regex({strip_sql(e)}, '[\s_-]+')) AS BIGINT)"


def dehyphenate(text: Column) -> Column:
    """Join words cut at line ends, fold blanks and tabs; newlines stay."""
    joined = F.regexp_replace(text, r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")
    return F.regexp_replace(joined, r"[ \t]+", " ")


def dehyphenate_sql(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g'), '[ \t]+', ' ', 'g')"


# Short names of hosted models, one table for extraction and one for evaluation runs.
EXTRACTION_MODELS = {"3.8": "gemini-3.8-flash", "3.8-flash": "gemini-3.8-flash", "3.8_flash": "gemini-3.8-flash", "gemini-3.8": "gemini-3.8-flash", "2.5": "gemini-2.5-flash", "2.5-flash": "gemini-2.5-flash", "2.5-pro": "gemini-2.5-pro", "pro": "gemini-2.5-pro", "flash": "gemini-2.5-flash"}
EVALUATION_MODELS = {**EXTRACTION_MODELS, "flash": "gemini-3.8-flash"}


def model_name(name: Column, table: dict[str, str] = EXTRACTION_MODELS) -> Column:
    """A short model name in full: by the table, else with the vendor's prefix."""
    c = F.regexp_replace(strip(name), "^models/", "")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(c))
    return F.coalesce(known, F.when(c.startswith("gemini-"), c).otherwise(F.concat(F.lit("gemini-"), c)))


def number_word(c: Column) -> Column:
    """Number words from zero to twelve as numbers; all others null."""
    names = "zero one two three four five six seven eight nine ten eleven twelve".split()
    return F.element_at(F.create_map(*[F.lit(x) for kv in zip(names, range(13)) for x in kv]), F.lower(strip(c)))


def yes_no(c: Column) -> Column:
    return F.when(F.lower(c) == "yes", 1).when(F.lower(c) == "no", 0)


def triple_text(subject: str, predicate: str, obj: str) -> Column:
    """A triple as it reads: (subject, predicate, object)."""
    return F.concat(F.lit("("), F.concat_ws(", ", subject, predicate, obj), F.lit(")"))
