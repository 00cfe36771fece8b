"""Export of a terminology as SKOS (N-Triples) or TBX (XML) by a Python data source.

    df.write.format("termlake_vocabulary").option("kind", "skos").mode("append").save(path)

Rows are concepts: ``concept_id``, ``labels`` (language, text, preferred), ``relations``
(kind, target) and ``identifiers`` (uri, mapping_type).  A task writes its part under a name of its
own below ``_parts``; the driver's commit moves the parts to their place and writes a
marker last, and an abort deletes them, so a failed job leaves nothing behind and
repeated tasks leave no part twice.  Folders must be in a store that pyarrow's file
systems open (local and mounted folders, S3, GCS, HDFS).

:func:`read_skos` gives labels and relations back.

Defined results: a null concept id is an error; null arrays are empty; labels without text
are left out; of several preferred labels of one language the first in text order stays
preferred; relations that SKOS has no word for become ``related``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "termlake_vocabulary"
SCHEMA = (
    "concept_id string, labels array<struct<language:string,text:string,preferred:boolean>>, "
    "relations array<struct<kind:string,target:string>>, identifiers array<struct<uri:string,mapping_type:string>>"
)
# fixed values: terms of the public vocabularies
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RELATIONS = {"BROADER_THAN": "narrower", "NARROWER_THAN": "broader", "RELATED_TO": "related"}
MATCHES = {"EXACT": "exactMatch", "CLOSE": "closeMatch", "BROAD": "broadMatch", "NARROW": "narrowMatch", "RELATED": "relatedMatch"}
BASE = "urn:termlake:concept:"
MARKER = "_COMMITTED"


def _literal(text: str) -> str:
    for plain, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(plain, coded)
    return f'"{text}"'


def _iri(value: str) -> str:
    return f"<{quote(value, safe=':/?#[]@!$&()*+,;=-._~%')}>"


def _own(concept: str) -> str:
    return f"<{BASE}{quote(concept, safe='')}>"


def _labels(row: Row) -> Iterator[tuple[str | None, str, bool]]:
    """Labels in text order; only the first preferred one of a language stays so."""
    seen = set()
    for label in sorted(row.labels or [], key=lambda x: (x.language or "", not x.preferred, x.text or "")):
        if label.text:
            preferred = bool(label.preferred) and label.language not in seen
            if preferred:
                seen.add(label.language)
            yield label.language, label.text, preferred


def skos(row: Row) -> str:
    """The N-Triples of a concept."""
    me = _own(row.concept_id)
    out = [f"{me} <{TYPE}> <{SKOS}Concept> ."]
    for language, text, preferred in _labels(row):
        out.append(f"{me} <{SKOS}{'prefLabel' if preferred else 'altLabel'}> {_literal(text)}{f'@{language}' if language else ''} .")
    for r in row.relations or []:
        out.append(f"{me} <{SKOS}{RELATIONS.get(r.kind, 'related')}> {_own(r.target)} .")
    for i in row.identifiers or []:
        out.append(f"{me} <{SKOS}{MATCHES.get((i.mapping_type or '').upper(), 'relatedMatch')}> {_iri(i.uri)} .")
    return "\n".join(out) + "\n"


def tbx(row: Row) -> str:
    """The entry of a concept."""
    by: dict[str, list[str]] = {}
    for language, text, preferred in _labels(row):
        note = "preferredTerm-admn-sts" if preferred else "admittedTerm-admn-sts"
        by.setdefault(language or "und", []).append(f'<termSec><term>{escape(text)}</term><termNote type="administrativeStatus">{note}</termNote></termSec>')
    links = "".join(f'<ref type="crossReference" target={quoteattr(r.target)}/>' for r in row.relations or [])
    sections = "".join(f"<langSec xml:lang={quoteattr(language)}>{''.join(terms)}</langSec>" for language, terms in sorted(by.items()))
    return f"<conceptEntry id={quoteattr(row.concept_id)}>{links}{sections}</conceptEntry>\n"


KINDS = {
    "skos": (".nt", "", skos, ""),
    "tbx": (".tbx", '<?xml version="1.0" encoding="UTF-8"?>\n<tbx type="TBX-Basic" style="dca" xml:lang="en" xmlns="urn:iso:std:iso:30042:ed-2"><text><body>\n', tbx, "</body></text></tbx>\n"),
}


@dataclass
class Part(WriterCommitMessage):
    name: str
    concepts: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.kind = options.get("kind", "skos")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        self.job = uuid.uuid4().hex
        # made once, here: a task that outlives an abort finds no folder to write to
        store, inner = self._store()
        store.create_dir(f"{inner}/_parts/{self.job}", recursive=True)

    def _store(self):
        from pyarrow import fs

        uri = self.path if "://" in self.path else "file://" + self.path.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[Row]) -> Part:
        ending, head, entry, foot = KINDS[self.kind]
        store, inner = self._store()
        name = f"part-{uuid.uuid4().hex}{ending}"
        count = 0
        with store.open_output_stream(f"{inner}/_parts/{self.job}/{name}") as out:
            out.write(head.encode())
            for row in iterator:
                if row.concept_id is None:
                    raise ValueError("a concept without an id")
                out.write(entry(row).encode())
                count += 1
            out.write(foot.encode())
        return Part(name, count)

    def commit(self, messages: list[Part | None]) -> None:
        """Only parts of tasks that ended well are moved; what other attempts wrote goes."""
        store, inner = self._store()
        for part in filter(None, messages):
            if part.concepts:
                store.move(f"{inner}/_parts/{self.job}/{part.name}", f"{inner}/{part.name}")
        self._clear(store, inner)
        with store.open_output_stream(f"{inner}/{MARKER}-{self.job}") as out:
            out.write(str(sum(p.concepts for p in messages if p)).encode())

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, inner: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{inner}/_parts/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{inner}/_parts/{self.job}")


class VocabularyExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("an export is appended to a folder of its own")
        return Writer(self.options)


def export(concepts: DataFrame, path: str, kind: str = "skos") -> None:
    """Writes concepts (columns of SCHEMA; others are left out) below path."""
    concepts.sparkSession.dataSource.register(VocabularyExport)
    names = [c.split()[0] for c in SCHEMA.replace("array<struct<", "array ").split(", ")]
    concepts.select(*[F.col(c) for c in names]).write.format(NAME).option("kind", kind).mode("append").save(path)


def concept_rows(concepts: DataFrame, terms: DataFrame, relations: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Store tables to rows of SCHEMA: concepts (id), terms (concept_id, language, text, is_preferred), relations
    (source_concept_id, relation_type, target_concept_id), identifiers (concept_id, uri, mapping_type)."""
    text = lambda c: F.col(c).cast("string")

    def listed(df: DataFrame, key: str, name: str, cell: Column) -> DataFrame:
        return df.groupBy(text(key).alias("concept_id")).agg(F.array_sort(F.collect_list(cell)).alias(name))

    out = concepts.select(text("id").alias("concept_id")).distinct()
    labels = F.struct("language", "text", F.col("is_preferred").alias("preferred"))
    out = out.join(listed(terms, "concept_id", "labels", labels), "concept_id", "left")
    out = out.join(listed(relations, "source_concept_id", "relations", F.struct(F.col("relation_type").alias("kind"), text("target_concept_id").alias("target"))), "concept_id", "left")
    return out.join(listed(identifiers, "concept_id", "identifiers", F.struct("uri", "mapping_type")), "concept_id", "left")


def read_skos(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels: concept_id, kind, language, text; relations: concept_id, kind, target) of an export."""
    lines = spark.read.option("pathGlobFilter", "*.nt").text(path)
    subject = F.url_decode(F.replace(F.regexp_extract("value", f"^<{BASE}([^>]*)>", 1), F.lit("+"), F.lit("%2B"))).alias("concept_id")
    kind = F.regexp_extract("value", f"^<[^>]*> <{SKOS}([A-Za-z]+)>", 1).alias("kind")
    label = r'^<[^>]*> <[^>]*> "((?:[^"\\]|\\.)*+)"(?:@([A-Za-z0-9-]+))? \.$'
    text = F.regexp_extract("value", label, 1)
    # the backslash last: its code is set aside first so that it opens no other code
    text = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    for coded, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0000", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    labels = lines.where(F.col("value").contains("Label> ")).select(subject, kind, F.nullif(F.regexp_extract("value", label, 2), F.lit("")).alias("language"), text.alias("text"))
    target = F.url_decode(F.replace(F.regexp_extract("value", f"> <{BASE}([^>]*)> \\.$", 1), F.lit("+"), F.lit("%2B")))
    relations = lines.select(subject, kind, target.alias("target")).where("kind in ('broader', 'narrower', 'related')")
    return labels, relations
