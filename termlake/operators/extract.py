"""Span extraction: one row of normalised text to any number of candidate spans.

All rules are native expressions.  Offsets count code points: the matches of a
pattern and the parts between them alternate, so a match starts after the
lengths of all that precede it; these are summed in time that is linear in the
number of matches, and no character of the text is looked up by its place.
A pattern passes over a text once: its matches are set between marks, and the text
is split at these.  Only a text that has the mark itself is passed over twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlake import vocab
from termlake.functions.arrays import let, sums_before

# fixed values: the patterns (Unicode classes where \w, \s or \d occur)
INCHI_KEY = r"\b[A-Z]{14}-[A-Z]{10}-[A-Z]\b"
INCHI = r"(?U)\bInChI=[^\s,;]+"
CAS_RN = r"(?U)\b[1-9][0-9]{1,6}-[0-9]{2}-[0-9]\b"
SMILES = r"(?U)(?i:\bSMILES\s*[:=]\s*)[^\s,;]+"
QUANTITY = (
    r"(?U)(?<![\w.])(?:\d+(?:\.\d+)?\s*(?:-|–|to)\s*)?\d+(?:\.\d+)?\s*"
    r"(?:°C|°F|K|wt\.?%|vol\.?%|mol%|%|ppm|ppb|mol|mmol|μmol|µmol|kg|mg|μg|µg|g|mL|μL|µL|L|MPa|kPa|Pa|mbar|bar|M|mM|μM|µM|"
    r"nm|μm|µm|mm|cm|mPa[·.]s)(?=$|[\s,;.)])"
)
PH = r"(?U)\bpH(?:\s*(?:of|=|:))?\s*\d+(?:\.\d+)?(?:\s*(?:-|–|to)\s*\d+(?:\.\d+)?)?"
LABEL = r"(?iU)\b(?:Compound|Intermediate|Example|Preparation)\s+[A-Z]?[0-9]+[A-Za-z]?\b"
ABBREVIATION = r"\([A-Z][A-Z0-9-]{1,10}\)"
FORMULA = r"(?U)\b(?:[A-Z][a-z]?[0-9]*){2,}+\b"
TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)*+"

#: A noncharacter, which texts for interchange don't have.
MARK = "\ufdd0"

KEYS = ("source_record_id", "text_unit_index", "language")
CANDIDATE = (
    "text string, start int, end int, types array<string>, roles array<string>, proposed_definition string, confidence double, "
    "extractor string, extractor_version string, raw_label string, needs_review boolean, metadata map<string,string>, seq int"
)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text, gap>> of the leftmost non-overlapping matches; gap is the text between a match and the one before it."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    # gap, match, gap, ..., match, rest
    once = let(parts, lambda p: F.filter(F.transform(p, lambda x, i: F.struct(x.alias("text"), F.get(p, i - 1).alias("gap"))), lambda x, i: i % 2 == 1))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    twice = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda hit, gap: F.struct(hit.alias("text"), gap.alias("gap")))
    pairs = F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)

    def placed(x: Column, at: Column) -> Column:
        start = (at + F.length(x["gap"])).cast("int")
        return F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end"), x["text"].alias("text"), x["gap"].alias("gap"))

    sizes = lambda p: F.transform(p, lambda x: (F.length(x["gap"]) + F.length(x["text"])).cast("long"))
    return let(pairs, lambda p: F.zip_with(p, sums_before(sizes(p)), placed))


def cas_valid(value: Column) -> Column:
    """Whether the last digit is the weighted sum of the others, weights counted from the right."""
    digits = F.reverse(F.split(F.replace(value, F.lit("-"), F.lit("")), ""))
    weighted = F.transform(digits, lambda d, i: d.cast("int") * i)
    return F.aggregate(weighted, F.lit(0), lambda s, v: s + v) % 10 == F.element_at(digits, 1).cast("int")


def formula_valid(value: Column) -> Column:
    """At least two element tokens and every symbol an element."""
    return let(F.regexp_extract_all(value, F.lit("[A-Z][a-z]?"), F.lit(0)), lambda symbols: (F.size(symbols) >= 2) & F.forall(symbols, lambda s: s.isin(*vocab.ELEMENTS)))


def _part(s: Column, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.substr(s["text"], start - s["start"] + 1, end - start).alias("text"))


def rule_spans(text: Column) -> dict[str, Column]:
    """label -> spans of each deterministic rule."""
    value = F.lit(r"(?U)(?i:\bSMILES\s*[:=]\s*)([^\s,;]+)")
    return {
        "INCHI_KEY": spans(text, INCHI_KEY),
        "INCHI": spans(text, INCHI),
        "CAS_RN": F.filter(spans(text, CAS_RN), lambda s: cas_valid(s["text"])),
        "SMILES": F.transform(spans(text, SMILES), lambda s: _part(s, s["end"] - F.length(F.regexp_extract_all(s["text"], value, F.lit(1))[0]), s["end"])),
        "QUANTITY": spans(text, QUANTITY),
        "PH": spans(text, PH),
        "PATENT_LABEL": spans(text, LABEL),
        "ABBREVIATION": F.transform(spans(text, ABBREVIATION), lambda s: _part(s, s["start"] + 1, s["end"] - 1)),
        "MOLECULAR_FORMULA": F.filter(spans(text, FORMULA), lambda s: formula_valid(s["text"])),
    }


# fixed values: type, confidence and review flag of each rule
RULES: dict[str, tuple[str, float, bool]] = {
    "INCHI_KEY": ("CHEMICAL_ENTITY", 0.99, False),
    "INCHI": ("CHEMICAL_ENTITY", 0.99, False),
    "CAS_RN": ("CHEMICAL_ENTITY", 0.99, False),
    "SMILES": ("CHEMICAL_ENTITY", 0.98, False),
    "QUANTITY": ("MEASUREMENT", 0.98, False),
    "PH": ("MEASUREMENT", 0.98, False),
    "PATENT_LABEL": ("OTHER_TECHNICAL_CONCEPT", 0.90, False),
    "ABBREVIATION": ("OTHER_TECHNICAL_CONCEPT", 0.85, True),
    "MOLECULAR_FORMULA": ("CHEMICAL_ENTITY", 0.92, False),
}


def _candidates(units: DataFrame, found: Column, keys: tuple[str, ...], seq: int, extractor: str) -> DataFrame:
    """Explodes array<struct<start,end,text,type,role,confidence,label,review,metadata>> to candidate rows."""
    rows = units.select(*keys, F.explode(found).alias("c"))
    return rows.select(
        *keys,
        F.col("c.text").alias("text"),
        F.col("c.start").alias("start"),
        F.col("c.end").alias("end"),
        F.array("c.type").alias("types"),
        F.when(F.col("c.role").isNotNull(), F.array("c.role")).otherwise(F.array().cast("array<string>")).alias("roles"),
        F.lit(None).cast("string").alias("proposed_definition"),
        F.col("c.confidence").alias("confidence"),
        F.lit(extractor).alias("extractor"),
        F.lit("1.0").alias("extractor_version"),
        F.col("c.label").alias("raw_label"),
        F.col("c.review").alias("needs_review"),
        F.col("c.metadata").alias("metadata"),
        F.lit(seq).alias("seq"),
    )


_NO_METADATA = lambda: F.create_map().cast("map<string,string>")


def extract_rules(units: DataFrame, text_col: str = "normalized", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Candidates of the nine deterministic rules."""
    def marked(label: str) -> Callable[[Column], Column]:
        kind, confidence, review = RULES[label]
        return lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(kind).alias("type"),
            F.lit(None).cast("string").alias("role"), F.lit(confidence).alias("confidence"), F.lit(label).alias("label"),
            F.lit(review).alias("review"), _NO_METADATA().alias("metadata"),
        )

    every = [F.transform(found, marked(label)) for label, found in rule_spans(F.col(text_col)).items()]
    return _candidates(units, F.concat(*every), keys, 0, "deterministic_rules")


def phrase_spans(text: Column, most: int = 4) -> Column:
    """array<struct<start, end, text, head, n>> of the phrases that end in a head word."""
    return let(spans(text, TOKEN), lambda tokens: F.flatten(_phrases(tokens, most)))


def _phrases(tokens: Column, most: int) -> Column:
    heads = list(vocab.HEAD_TYPE)
    prev = lambda i, k: F.get(tokens, i - k)
    joins = lambda i, k: F.coalesce(
        ~F.lower(prev(i, k)["text"]).isin(*vocab.BOUNDARY_WORDS) & F.regexp_like(prev(i, k - 1)["gap"], F.lit(r"^(?U)[\s\x1c-\x1f]+$")), F.lit(False)
    )

    def ending(x: Column, i: Column) -> Column:
        ok, phrase, out = F.lit(True), x["text"], []
        for n in range(2, most + 1):
            ok = ok & joins(i, n - 1)
            phrase = F.concat(prev(i, n - 1)["text"], prev(i, n - 2)["gap"], phrase)
            found = F.struct(prev(i, n - 1)["start"].alias("start"), x["end"].alias("end"), phrase.alias("text"), x["text"].alias("head"), F.lit(n).alias("n"))
            out.append(F.when(ok, found))
        found = F.filter(F.array(*out), lambda s: s.isNotNull())
        return F.when(F.lower(x["text"]).isin(*heads), found).otherwise(F.slice(F.array(*[F.when(F.lit(False), o) for o in out]), 1, 0))

    return F.transform(tokens, ending)


def extract_phrases(units: DataFrame, text_col: str = "normalized", keys: tuple[str, ...] = KEYS, most: int = 4) -> DataFrame:
    """Candidates of nested technical phrases."""
    if most < 2:
        raise ValueError("most must be at least 2")
    with_phrases = units.select(*keys, phrase_spans(F.col(text_col), most).alias("_phrases"))
    kinds, roles = vocab.map_column(vocab.HEAD_TYPE), vocab.map_column(vocab.HEAD_ROLE)
    found = F.transform(
        "_phrases",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), kinds[F.lower(s["head"])].alias("type"),
            roles[F.lower(s["head"])].alias("role"), F.least(F.lit(0.88), F.lit(0.64) + F.lit(0.05) * s["n"]).alias("confidence"),
            F.concat(kinds[F.lower(s["head"])], F.lit("_PHRASE")).alias("label"), F.lit(True).alias("review"),
            F.create_map(F.lit("head"), s["head"], F.lit("token_count"), s["n"].cast("string")).alias("metadata"),
        ),
    )
    return _candidates(with_phrases, found, keys, 1, "technical_phrase_rules")


def model_labels(predictions: DataFrame, extractor: str, label_types: Mapping[str, str], label_roles: Mapping[str, str], seq: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Candidates from model predictions (keys, text, start, end, label, score): prefix, type and role of a label."""
    label = F.regexp_replace(F.regexp_replace("label", "^B-", ""), "^I-", "")
    upper = F.upper("raw_label")
    fallback = (
        F.when(upper.contains("CHEM") | upper.contains("COMPOUND") | upper.contains("SUBSTANCE"), "CHEMICAL_ENTITY")
        .when(upper.contains("MATERIAL"), "MATERIAL")
        .otherwise("OTHER_TECHNICAL_CONCEPT")
    )
    none = F.lit(None).cast("string")
    kind = vocab.map_column(dict(label_types))[F.col("raw_label")] if label_types else none
    role = vocab.map_column(dict(label_roles))[F.col("raw_label")] if label_roles else none
    rows = predictions.withColumn("raw_label", label)
    return rows.select(
        *keys, "text", "start", "end",
        F.array(F.coalesce(kind, fallback)).alias("types"),
        F.when(role.isNotNull(), F.array(role)).otherwise(F.array().cast("array<string>")).alias("roles"),
        none.alias("proposed_definition"), F.col("score").cast("double").alias("confidence"), F.lit(extractor).alias("extractor"),
        F.lit("1.0").alias("extractor_version"), "raw_label", (F.col("raw_label") == "REAGENT_CATALYST").alias("needs_review"),
        _NO_METADATA().alias("metadata"), F.lit(seq).alias("seq"),
    )


def mention_candidates(mentions: DataFrame, extractor: str, seq: int, text_col: str = "normalized", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Candidates from the mentions (keys, normalized, text, start, end, score or null) of a chemical entity recogniser.

    A mention whose text is not what stands at its place is an error.
    """
    stands = F.substr(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    wrong = F.raise_error(F.concat(F.lit("a mention does not stand at its place: "), F.col("text"))).cast("string")
    none = F.lit(None).cast("string")
    return mentions.select(
        *keys, F.when(stands, F.col("text")).otherwise(wrong).alias("text"), "start", "end", F.array(F.lit("CHEMICAL_ENTITY")).alias("types"),
        F.array().cast("array<string>").alias("roles"), none.alias("proposed_definition"), F.coalesce(F.col("score").cast("double"), F.lit(0.9)).alias("confidence"),
        F.lit(extractor).alias("extractor"), F.lit("1.0").alias("extractor_version"), F.lit("CEM").alias("raw_label"), F.lit(False).alias("needs_review"),
        _NO_METADATA().alias("metadata"), F.lit(seq).alias("seq"),
    )


def apply_model(units: DataFrame, load: Callable[[], Callable[[str], list[dict]]], text_col: str = "normalized", keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Predictions and failures of an injected model.

    load gives the model and is called once a task; the model maps a text to
    dicts with start, end, entity (or entity_group) and score.  A text on which
    the model fails, or gives a span outside of the text, is a row of failures.
    """
    fields = [units.schema[k] for k in keys]
    schema = T.StructType(
        [*fields, *[T.StructField(n, t) for n, t in (("text", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("label", T.StringType()), ("score", T.DoubleType()), ("error", T.StringType()))]]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                text, key = record[text_col], [record[k] for k in keys]
                try:
                    found = [(int(p["start"]), int(p["end"]), p.get("entity_group") or p.get("entity") or "UNKNOWN", float(p.get("score", 0))) for p in model(text)]
                    if bad := [f for f in found if not 0 <= f[0] < f[1] <= len(text)]:
                        raise ValueError(f"span [{bad[0][0]}, {bad[0][1]}) is not in the text")
                    rows += [(*key, text[a:b], a, b, label, score, None) for a, b, label, score in found]
                except Exception as error:  # a model's failure is a result: other texts go on
                    rows.append((*key, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=schema.names)

    out = units.select(*keys, text_col).mapInPandas(run, schema)
    issues = out.where("error is not null").select(*keys, F.lit("EXTRACTOR_FAILED").alias("code"), F.col("error").alias("message"))
    return out.where("error is null").drop("error"), issues
