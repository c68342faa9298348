"""Chat formatting: records of many layouts to canonical turns, marked text and a loss mask.

A record is JSON.  The nested field paths it uses (names and lists, without
scalar types and values) are hashed; the hash selects a declarative
:class:`Mapping`, which says where roles and texts lie.  Mappings compile to column expressions, so records are read, formatted
and masked inside Spark SQL:

* ``canonical``: record -> layout, turns array<struct<role,text>>;
* ``formatted``: turns -> text with marks, mask as runs (plain, loss) of code points;
* ``read_back``: formatted pieces -> turns, loss text and digests, by streaming
  over pieces in order, so a conversation of any length is never held whole.

Texts that contain a mark, however it is already escaped, get one backslash more
behind its opening bracket, and reading takes one away: a bijection that leaves
all other texts as they are, and no mark inside a text.

Edge cases: null texts and roles are empty; a record that is not JSON (or above
Spark's limit for a variant, about 100 MB), and one of no declared layout, has null
layout and turns, and is passed on as such; lists without turns format to nothing; optional fields may be
missing; roles outside user, assistant and system keep their name; rows with equal
turn are ordered by role, then text; a null conv_id is a conversation; repeated
rows are turns each; extra columns pass ``canonical`` and ``formatted``, one with a
name they write is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm import common

PIECE = 16
SCALAR = r"(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|VARIANT|BINARY|DATE|UUID|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))"
MARKS = ["s", "INST", "SYS", "ROLE", "TEXT"]
_TAG = "/?(?:" + "|".join(MARKS) + ")"
#: role -> (mark before its text, mark after); other roles are written out.
TEMPLATE = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout lie.

    Either a list (``turns``, with ``role`` and ``text`` paths inside an entry), or
    one turn for each of ``parts``: (role, paths); a turn's paths are joined by a
    blank line, empty ones are left out, and a part whose paths are all missing is no turn.
    """
    name: str
    turns: str = ""
    role: str = "role"
    text: str = "content"
    parts: tuple = ()
    roles: tuple = ()
    optional: tuple = ()

    def paths(self) -> set:
        if self.turns:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        return {p for _, ps in self.parts for p in ps}

    def shapes(self) -> list[str]:
        """Every set of field paths this mapping reads: with any of the optional ones, and with an empty list."""
        must, may = self.paths() - set(self.optional), sorted(self.optional)
        out = [shape(must | set(c)) for c in
               chain.from_iterable(combinations(may, k) for k in range(len(may) + 1)) if must | set(c)]
        return out + ([shape({self.turns + "[]"})] if self.turns else [])

    def read(self, v: Column) -> Column:
        if self.turns:
            names = F.create_map(*[F.lit(x) for x in chain.from_iterable(self.roles)]) if self.roles else None

            def turn(t):
                role = scalar(t, self.role)
                return F.struct((F.coalesce(F.element_at(names, role), role) if self.roles else role).alias("role"),
                                scalar(t, self.text).alias("text"))
            return F.transform(F.try_variant_get(v, f"$.{self.turns}", "array<variant>"), turn)
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.array_join(F.filter(
            F.array(*[scalar(v, p) for p in ps]), lambda x: x != "") if len(ps) > 1 else F.array(scalar(v, ps[0])), "\n\n")
            .alias("text"), F.array_contains(F.array(*[has(v, p) for p in ps]), True).alias("has"))
            for role, ps in self.parts])
        return F.transform(F.filter(turns, lambda t: t["has"]),
                           lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()


def scalar(v: Column, path: str) -> Column:
    """Text at a path: strings as they are, JSON null and nothing empty, other values as JSON."""
    at = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(at.isNull() | F.is_variant_null(at), "").otherwise(
        F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.to_json(at)))


#: Declared layouts; the first one that knows a shape reads it.
MAPPINGS = (
    Mapping("messages", turns="messages", optional=("id", "messages[].name")),
    Mapping("sharegpt", turns="conversations", role="from", text="value", optional=("id",),
            roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("dialogue", turns="dialog.turns", role="speaker.role", text="utterance.text"),
    Mapping("completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", parts=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",))),
            optional=("system_prompt",)),
    Mapping("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")),
                                  ("assistant", ("output",))), optional=("system", "input")),
)


def shape(paths) -> str:
    """Canonical text of a set of field paths, as Spark prints a variant's schema without scalar types."""
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})

    def text(node: dict) -> str:
        return "OBJECT<" + ", ".join(
            k[:-2] + ": ARRAY<" + (text(c) if c else "") + ">" if k.endswith("[]") else k + (": " + text(c) if c else "")
            for k, c in sorted(node.items())) + ">"
    return text(tree)


def fingerprint(v: Column) -> Column:
    """Hash of the nested field paths of a variant."""
    paths = F.regexp_replace(F.schema_of_variant(v), F.lit(": " + SCALAR + "(?=[,>])"), F.lit(""))
    return F.xxhash64(F.regexp_replace(paths, F.lit("<" + SCALAR + ">"), F.lit("<>")))


def layouts(spark: SparkSession, mappings) -> dict[int, str]:
    """Fingerprint -> name over all shapes of the mappings; the first mapping of a shape has it."""
    rows = [(i, m.name, s) for i, m in enumerate(mappings) for s in m.shapes()]
    found = spark.createDataFrame(rows, "i int, name string, shape string").select(
        "i", "name", F.xxhash64("shape").alias("h")).orderBy(F.desc("i")).collect()
    return {r["h"]: r["name"] for r in found}


def canonical(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Adds layout string and turns array<struct<role,text>> to records of JSON text."""
    known = layouts(records.sparkSession, mappings)
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    v, out = F.col("_variant"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in reversed(mappings):
        out = F.when(F.col("layout") == m.name, m.read(v)).otherwise(out)
    return (records.withColumn("_variant", F.try_parse_json(record))
            .withColumn("layout", F.element_at(names, fingerprint(v))).withColumn("turns", out).drop("_variant"))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rf"([<\[])(\\*{_TAG}[>\]])"), F.lit(r"$1\\$2"))


UNESCAPE = re.compile(rf"([<\[])\\(\\*{_TAG}[>\]])")
READ = re.compile("|".join([rf"{re.escape(a)}(?P<{r}>.*?){re.escape(b)}" for r, (a, b) in TEMPLATE.items()]
                           + ["(?P<name>.*?)".join(map(re.escape, OTHER[:2])) + "(?P<other>.*?)" + re.escape(OTHER[2])]),
                  re.DOTALL)


def formatted(df: DataFrame, turns: str = "turns", loss_roles=("assistant",)) -> DataFrame:
    """Adds formatted string and mask array<struct<plain long, loss long>> (run lengths in code points)."""

    def cut(t):
        head, tail = F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1])), F.lit(OTHER[2])
        for role, (a, b) in TEMPLATE.items():
            head = F.when(t["role"] == role, F.lit(a)).otherwise(head)
            tail = F.when(t["role"] == role, F.lit(b)).otherwise(tail)
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), tail.alias("tail"),
                        t["role"].isin(*loss_roles).alias("loss"))

    def runs(p):
        size = [F.length(p[x]).cast("long") for x in ("head", "body", "tail")]
        zero = F.lit(0).cast("long")
        return F.when(p["loss"], F.array(F.struct(size[0].alias("plain"), size[1].alias("loss")),
                                         F.struct(size[2].alias("plain"), zero.alias("loss")))).otherwise(
            F.array(F.struct((size[0] + size[1] + size[2]).alias("plain"), zero.alias("loss"))))

    clean = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"),
                                                  F.coalesce(t["text"], F.lit("")).alias("text")))
    return (df.withColumn("_cut", F.transform(clean, cut))
            .withColumn("formatted", F.array_join(F.transform("_cut", lambda p: F.concat(p["head"], p["body"], p["tail"])), ""))
            .withColumn("mask", F.flatten(F.transform("_cut", runs))).drop("_cut"))


def turns_of(text: str):
    """(role, text) turns of a formatted text; a text that is not made of whole turns is an error."""
    at = 0
    for m in READ.finditer(text):
        if m.start() != at:
            break
        at, kind = m.end(), m.lastgroup
        role = UNESCAPE.sub(r"\1\2", m["name"]) if kind == "other" else kind
        yield role, UNESCAPE.sub(r"\1\2", m[kind])
    if at != len(text):
        raise ValueError("text outside of turns")


def loss_of(text: str, mask: list):
    """Unescaped texts under a loss mask."""
    at = 0
    for run in mask:
        at += run["plain"]
        yield UNESCAPE.sub(r"\1\2", text[at:at + run["loss"]])
        at += run["loss"]


def read_back(pieces: DataFrame, key: str = "conv_id", order: str = "piece") -> DataFrame:
    """Digests per conversation, read from (key, order, formatted, mask).

    Formatting is done a piece; here a conversation's pieces pass in order through
    one task, which keeps two hash states, as the digest of an ordered text needs.
    Pieces of a null text (unknown layouts) add nothing.
    """
    fields = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        state, own = None, None

        def close(rows):
            if state is not None:
                rows.append((own, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                              names=[key, *fields])

        for batch in batches:
            rows: list = []
            for k, text, mask in zip(*(batch.column(i) for i in range(3))):
                k = k.as_py()
                if state is None or k != own:
                    close(rows)
                    own, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                if text is None:
                    continue
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for said in loss_of(text, mask.as_py()):
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield batch_of(rows)
        rows = []
        close(rows)
        yield batch_of(rows)

    ordered = pieces.select(F.col(key).cast("long").alias(key), F.col(order).alias("_order"), "formatted", "mask")
    ordered = ordered.repartition(key).sortWithinPartitions(key, "_order").select(key, "formatted", "mask")
    return ordered.mapInArrow(read, f"{key} long, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long")


def records_of_turns(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv_id, piece, record): a table of turn rows as JSON records of at most ``size`` turns.

    Whole conversations of a prompt and its answer, with or without a system
    text, become flat records, others lists in one of two layouts.
    """
    t = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("at", F.row_number().over(w) - 1).withColumn("piece", F.floor(F.col("at") / size).cast("long"))
    t = t.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])

    def said(i):
        return F.element_at("t", i)["text"]

    def listed(name, role, text):
        return F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(text))).alias(name)))

    plain = F.forall("t", lambda x: x["role"].isin(*TEMPLATE))
    record = (F.when(roles == F.array(F.lit("user"), F.lit("assistant")),
                     F.to_json(F.struct(said(1).alias("prompt"), said(2).alias("completion"))))
              .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
                    F.to_json(F.struct(said(1).alias("system"), said(2).alias("instruction"), said(3).alias("output"))))
              .when(plain & (F.element_at(roles, 1) == "system"), listed("conversations", "from", "value"))
              .otherwise(listed("messages", "role", "content")))
    return t.select("conv_id", "piece", record.alias("record"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    records = records_of_turns(rows.unionByName(extra))
    return read_back(formatted(canonical(records)))
