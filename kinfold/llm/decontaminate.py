"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Words are runs of letters, and numbers with their inner points and commas. A template puts a typed placeholder for each number and for each unit right after a number; the rest is
lower-cased. A text has two templates: in one every capitalised word of two letters or more is a name and has a placeholder too (so a question with other names meets its source, also
where a name begins a sentence), in the other no word is (so a copy in other case does).

A match is a run of ``run`` consecutive words, or all words of a shorter item, that are equal in one of the templates. Every window of ``window`` words of an item is hashed, and of a
document every ``run - window + 1``-th: a run of that many words holds a whole one of them, wherever it begins (a shorter item in the benchmark makes the steps smaller). They meet in a
hash join, and what meets is aligned word by word, so hashes and steps lose nothing and decide nothing. The slots are compared inside the runs: each filler of the item must stand
for one filler of the document, by type of slot (3 for 5 everywhere, not 3 for 5 here and 7 there; two fillers of the item may stand for the same one). With equal fillers that is a
verbatim copy; with other but consistent fillers a re-parameterised question, if at least ``literals`` of the words in runs are words and not slots; else the match is dropped.

Whole texts take part. A window of nothing but slots says nothing and is none, and a run that holds such a window is none, so a page of numbers costs no more than another. What one offset needs of a document is cut out to the length of the item, so the work is linear in the texts times the repetitions inside an item. The benchmark's windows and texts are broadcast while their
number and bytes are small (counted first), else they are joined by shuffle.

Defined cases: null or empty texts match nothing. An item with fewer than ``shortest`` words is found only where it is the whole document (case aside); one with fewer than ``run`` is
matched whole. An item without words, or of slots alone, matches nothing. Repeated documents and items are each reported. Rows are told apart by (id, text), so null or repeated ids do
no harm. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import shared

# Units of measure that follow a number.
UNITS = "km|cm|mm|kg|mg|lbs|lb|oz|ml|mph|kmh|kwh|hz|khz|mhz|ghz|kb|mb|gb|tb|usd|eur|dollars|dollar|euros|euro|cents|percent|meters|meter|metres|metre|miles|mile|feet|foot|inches|inch|grams|gram|litres|litre|liters|liter|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year"
NUMBER, NAME, UNIT = "0", "ǂ", "ǁ"
_SLOTS = (NUMBER, NAME, UNIT)
_WORD = r"\p{L}+|\p{N}+(?:[.,]\p{N}+)*"


@dataclass(frozen=True)
class DecontamConfig:
    window: int = 8
    run: int = 13
    shortest: int = 5
    literals: int = 4
    broadcast_windows: int = 1_000_000
    broadcast_bytes: int = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def is_number(w: Column) -> Column:
    """A word's first character is a numeral; ASCII is told by order alone."""
    return F.when(w < "A", True).when(w < "{", False).otherwise(w.rlike(r"^\p{N}"))


def is_name(w: Column) -> Column:
    """A capitalised word of two letters or more."""
    return F.when(w < "A", False).when(w < "[", F.length(w) > 1).when(w < "{", False).otherwise(w.rlike(r"^\p{Lu}\p{L}"))


def template(ws: Column, names: bool) -> Column:
    """The words with placeholders; ``names``: capitalised words are slots."""

    def one(w, i):
        after = F.coalesce(is_number(F.get(ws, i - 1)), F.lit(False))
        plain = F.when(is_number(w), NUMBER).when(after & F.lower(w).isin(UNITS.split("|")), UNIT).otherwise(F.lower(w))
        return F.when(is_name(w), NAME).otherwise(plain) if names else plain

    return F.transform(ws, one)


def _worked_out(rows: DataFrame, **cols: Column) -> DataFrame:
    """``rows`` with columns that are worked out once a row. A plain projection is merged into its user, and a column that a loop over words reads would be made again for each word;
    a generator is never merged."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_x")).select("*", "_x.*").drop("_x")


def _cut(tokens: Column, size: int, step: int) -> Column:
    """Hashes of the windows of ``size`` words that begin at 0, ``step``, 2 * ``step`` ..."""
    most = F.size(tokens) - size
    return F.when(most >= 0, F.transform(F.sequence(F.lit(0), most, F.lit(step)), lambda i: F.xxhash64(F.slice(tokens, i + 1, size)))).otherwise(F.array().cast("array<bigint>"))


def _whole(ws: Column) -> Column:
    """A hash of a text of few words as a whole."""
    return F.xxhash64(F.lit("whole"), F.transform(ws, lambda w: F.lower(w)))


def _telling(tokens: Column, size: Column) -> Column:
    """Starts (from 0) of the windows that hold a word and not slots only."""
    return F.filter(F.sequence(F.lit(0), F.size(tokens) - size), lambda i: F.exists(F.slice(tokens, i + 1, size), lambda w: ~w.isin(*_SLOTS)))


def row_id(id_col: str) -> Column:
    """One number for a row's id and text; equal rows share it."""
    return F.xxhash64(F.col(id_col), F.col("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig(), id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Per leaked (document, item): row_id, doc_id, item_id, n_words (of the item), aligned (its words that match), verbatim."""
    spark = docs.sparkSession
    tmp = shared.Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").alias("item_text")).filter("item_text is not null").distinct()
    items = _worked_out(items, ws=words(F.col("item_text")))
    items = items.withColumn("n_words", F.size("ws")).filter("n_words > 0").withColumn("item_key", F.xxhash64("item_id", "item_text")).drop("item_text")
    items = items.withColumn("run", F.least(F.col("n_words"), F.lit(cfg.run))).withColumn("size", F.least(F.col("n_words"), F.lit(cfg.window)))
    items = _worked_out(items, it_n=template(F.col("ws"), False), it_a=template(F.col("ws"), True))
    items = _worked_out(items, **{f"starts_{t}": _telling(F.col(f"it_{t}"), F.col("size")) for t in "na"})
    # a run tells something if each of its windows does
    whole = lambda t: F.filter(F.sequence(F.lit(0), F.col("n_words") - F.col("run")), lambda i: F.forall(F.sequence(i, i + F.col("run") - F.col("size")), lambda j: F.array_contains(f"starts_{t}", j)))
    items = tmp.write(_worked_out(items, **{f"runs_{t}": whole(t) for t in "na"}))
    long = items.filter(F.col("n_words") >= cfg.shortest)
    # sizes of windows (window, and below it those of shorter items: at most window - shortest more) and the steps at which documents are cut
    steps = {r[0]: r[1] for r in long.groupBy("size").agg(F.min(F.col("run") - F.col("size") + 1)).collect()}
    target = items.filter(F.col("n_words") < cfg.shortest).select("item_key", F.lit(0).alias("ipos"), _whole(F.col("ws")).alias("w"))
    for s in steps:
        for t in "na":
            own = long.filter(F.col("size") == s).select("item_key", f"starts_{t}", F.posexplode(_cut(F.col(f"it_{t}"), s, 1)).alias("ipos", "w"))
            target = target.unionByName(own.filter(F.array_contains(f"starts_{t}", F.col("ipos"))).select("item_key", "ipos", "w"))
    target = tmp.write(target)
    bytes_held = items.agg(F.sum(F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16))).first()[0] or 0
    few = target.count() <= cfg.broadcast_windows and 6 * bytes_held <= cfg.broadcast_bytes
    held = F.broadcast if few else lambda t: t

    rows = _worked_out(docs.filter("text is not null").select(row_id(id_col).alias("row_id"), "text"), ws=words(F.col("text"))).drop("text")
    rows = _worked_out(rows, tn=template(F.col("ws"), False))
    rows = _worked_out(rows, ta=F.zip_with("ws", "tn", lambda w, t: F.when(is_name(w), NAME).otherwise(t)))
    rows = _worked_out(rows, **{f"{t}_{s}": _cut(F.col(f"t{t}"), s, step) for s, step in steps.items() for t in "na"})
    # what is the same in both templates is looked up once
    both = [x for s in steps for x in (F.col(f"n_{s}"), F.zip_with(f"n_{s}", f"a_{s}", lambda x, y: F.when(x != y, y)))]
    whole = F.when(F.size("ws").between(1, cfg.shortest - 1), F.array(_whole(F.col("ws")))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("row_id", *[F.size(f"n_{s}").alias(f"m_{s}") for s in steps], F.posexplode(F.concat(*both, whole)).alias("at", "w")).filter("w is not null")
    # the place in the joined lists tells the list, and the place in the text
    dpos, before = F.lit(0), F.lit(0)
    for s, step in steps.items():
        for _ in "na":
            dpos = F.when(F.col("at") >= before, (F.col("at") - before) * step).otherwise(dpos)
            before = before + F.col(f"m_{s}")
    dpos = F.when(F.col("at") >= before, 0).otherwise(dpos)
    hits = rows.join(held(target), "w").select("row_id", "item_key", (dpos - F.col("ipos")).alias("shift"))
    near = tmp.write(hits.distinct())
    facts = items.select("item_key", "item_id", F.col("ws").alias("iw"), "n_words", "run", "it_n", "it_a", "runs_n", "runs_a")
    # texts of candidate documents only; the candidates' table is written, so its size decides how it is joined
    mine = docs.select(row_id(id_col).alias("row_id"), F.col(id_col).alias("doc_id"), "text").join(near.select("row_id").distinct(), "row_id", "left_semi").dropDuplicates(["row_id"])
    mine = tmp.write(mine.select("row_id", "doc_id", words(F.col("text")).alias("dws")))
    both = near.join(mine, "row_id").join(held(facts), "item_key")
    # the part of the document under the item, with the word before it (a unit follows a number)
    cut = F.transform(F.sequence(F.lit(0), F.col("n_words")), lambda i: F.get(F.col("dws"), i + F.col("shift") - 1))
    both = both.select("row_id", "doc_id", "item_key", "item_id", "iw", "n_words", "run", "it_n", "it_a", "runs_n", "runs_a", cut.alias("cut"))
    both = tmp.write(both)
    rest = lambda a: F.slice(a, 2, F.col("n_words"))
    sides = [F.struct(rest(template(F.col("cut"), names)).alias("dt"), F.col(f"it_{t}").alias("it"), F.col(f"runs_{t}").alias("runs")) for t, names in (("n", False), ("a", True))]
    lined = both.select("row_id", "doc_id", "item_key", "item_id", "iw", "n_words", "run", rest("cut").alias("dw"), F.explode(F.array(*sides)).alias("m"))
    lined = lined.select("*", "m.*").drop("m")
    lined = _worked_out(lined, eq=F.zip_with("dt", "it", lambda x, y: F.coalesce(x == y, F.lit(False))))
    # only words inside runs count: others are equal by chance
    lined = _worked_out(lined, found=F.filter("runs", lambda i: F.forall(F.slice("eq", i + 1, F.col("run")), lambda x: x))).filter(F.size("found") > 0)
    within = F.filter(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.exists("found", lambda a: (a <= i) & (i < a + F.col("run"))))
    lined = _worked_out(lined, same=F.transform(within, lambda i: F.struct(F.get("it", i).alias("it"), F.lower(F.get("iw", i)).alias("iw"), F.lower(F.get("dw", i)).alias("dw"))))
    slot = lambda x: x["it"].isin(*_SLOTS)
    lined = _worked_out(lined, slots=F.array_distinct(F.filter("same", slot)))
    one_each = F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["it"], x["iw"])))) == F.size("slots")
    equal = F.size(F.filter("slots", lambda x: x["iw"] != x["dw"])) == 0
    literal = F.size(F.filter("same", lambda x: ~slot(x)))
    out = lined.select("row_id", "doc_id", "item_id", "item_key", "n_words", F.size("same").alias("aligned"), equal.alias("verbatim"), one_each.alias("consistent"), literal.alias("literal"))
    out = out.filter(F.col("consistent") & (F.col("verbatim") | ((F.col("literal") >= cfg.literals) & (F.col("n_words") >= cfg.shortest))))
    best = out.groupBy("row_id", "doc_id", "item_id", "item_key", "n_words").agg(F.max(F.struct("aligned", "verbatim")).alias("b"))
    return best.select("row_id", "doc_id", "item_id", "n_words", F.col("b.aligned").alias("aligned"), F.col("b.verbatim").alias("verbatim"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    tmp = shared.Scratch(docs.sparkSession, "clean")
    name = shared.unused(docs, "row_id")
    leaks = tmp.write(find_leaks(docs.select(id_col, "text"), benchmark, cfg, id_col).select(F.col("row_id").alias(name)).distinct())
    return docs.withColumn(name, row_id(id_col)).join(leaks, name, "left_anti").select(*docs.columns)


def sql(cfg: DecontamConfig = DecontamConfig()) -> str:
    """The same leaks in DuckDB's SQL, with windows as lists of words and no hashes."""
    units = ", ".join(f"'{u}'" for u in UNITS.split("|"))
    slots = ", ".join(f"'{s}'" for s in _SLOTS)

    def texts(table: str, name: str, key: str) -> str:
        plain = f"CASE WHEN regexp_matches(w, '^\\p{{N}}') THEN '{NUMBER}' WHEN i > 1 AND regexp_matches(ws[i - 1], '^\\p{{N}}') AND lower(w) IN ({units}) THEN '{UNIT}' ELSE lower(w) END"
        return f"""{name}0 AS (SELECT DISTINCT {key}, text FROM {table} WHERE text IS NOT NULL),
{name}1 AS (SELECT {key}, row_number() OVER () AS {name}k, regexp_extract_all(text, '{_WORD}') AS ws FROM {name}0),
{name} AS (SELECT *, len(ws) AS n, list_transform(ws, lambda w, i: {plain}) AS tn,
  list_transform(ws, lambda w, i: CASE WHEN regexp_matches(w, '^\\p{{Lu}}\\p{{L}}') THEN '{NAME}' ELSE {plain} END) AS ta FROM {name}1 WHERE len(ws) > 0)"""

    def windows(name: str, size: str, rest: str) -> str:
        return " UNION ALL ".join(f"SELECT {name}k, '{t}' AS t, p AS {name}pos, {size} AS size, t{t}[p : p + {size} - 1] AS w FROM {rest}, unnest(range(1, n - {size} + 2)) u(p) WHERE n >= {size}" for t in "na")

    return f"""
WITH {texts("documents", "d", "doc_id")},
{texts("benchmark", "b", "item_id")},
bs AS (SELECT *, least(n, {cfg.run}) AS size FROM b),
bw AS (SELECT * FROM ({windows("b", "size", "bs")}) WHERE len(list_filter(range(1, size - least(size, {cfg.window}) + 2), lambda j: len(list_filter(w[j : j + least(size, {cfg.window}) - 1], lambda x: x NOT IN ({slots}))) = 0)) = 0),
sizes AS (SELECT DISTINCT size FROM bs),
dw AS ({windows("d", "size", "d, sizes")}),
hit AS (SELECT dk, bk, t, dpos - bpos AS shift, bpos, bw.size FROM dw JOIN bw USING (t, w)),
fit AS (SELECT hit.* FROM hit JOIN bs USING (bk) JOIN d USING (dk) WHERE bs.n >= {cfg.shortest} OR (d.n = bs.n AND list_transform(d.ws, lambda x: lower(x)) = list_transform(bs.ws, lambda x: lower(x)))),
spot AS (SELECT DISTINCT dk, bk, t, shift, bpos + j AS p FROM fit, unnest(range(0, size)) u(j)),
word AS (SELECT dk, bk, t, shift, CASE t WHEN 'n' THEN b.tn[p] ELSE b.ta[p] END AS tok, lower(b.ws[p]) AS iw, lower(d.ws[p + shift]) AS dw FROM spot JOIN b USING (bk) JOIN d USING (dk)),
lined AS (SELECT dk, bk, count(*) AS aligned, count(*) FILTER (tok NOT IN ({slots})) AS literal, coalesce(bool_and(iw = dw) FILTER (tok IN ({slots})), true) AS verbatim,
  count(DISTINCT (tok, iw)) FILTER (tok IN ({slots})) = count(DISTINCT (tok, iw, dw)) FILTER (tok IN ({slots})) AS consistent FROM word GROUP BY dk, bk, t, shift),
good AS (SELECT *, row_number() OVER (PARTITION BY dk, bk ORDER BY aligned DESC, verbatim DESC) AS r FROM lined JOIN b USING (bk) WHERE consistent AND (verbatim OR (literal >= {cfg.literals} AND n >= {cfg.shortest})))
SELECT d.doc_id, good.item_id, good.n::INTEGER AS n_words, good.aligned::INTEGER AS aligned, good.verbatim FROM good JOIN d USING (dk) WHERE r = 1"""
