"""Operator 1, personal data: information-theoretic sanitisation, in DataFrame operations only.

Patterns find the protected entities (e-mail, IPv4, card and phone numbers). The corpus then estimates how strongly the
words around an entity reveal it. With windows of about 2 x ``REACH`` characters as the unit, an entity c in n(c) of N windows has
the information content IC(c) = -log2(n(c)/N), and a term t seen cf(t) times in distinct text, in n(c,t) of the windows
around c, reveals PMI(c;t) = log2(n(c,t) N / (n(c) cf(t))) bits of it (Sanchez and Batet's disclosure criterion). The
disclosure is PMI/IC, 1 for a term that is never seen elsewhere. Terms at or above ``GENERALISE`` are replaced by a
class, at or above ``REMOVE`` removed, wherever they stand in a document that holds the entity: windows only serve to
estimate. They reach to the end of the word at the ``REACH``-th character. A window counts once for each distinct
text, and a pair needs ``SUPPORT`` such windows, so that copies of a document are no evidence. For the same reason cf and
N count a line or sentence once, however many copies hold it between the same neighbours; near copies add only the
lines that differ and those beside them.

Counts cover all documents. The windows around entities hold a bounded number of words, so pairs grow with the text,
never with the square of a group. Terms are counted with partial sums before the shuffle; nothing is broadcast unless
its table is small on disk.

Defined results: null and empty texts have no spans. Repeated rows and doc_ids are separate rows. An empty table gives
an empty result. Only the id and the text are read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, scratch_dir

#: Fixed patterns, in the order of the kinds. Possessive, and anchored where a run of characters begins, so that long
#: runs take linear time; they match what the plain patterns match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: A character that any match of the kind holds; texts without it skip the pattern.
NEEDS = {"email": "@", "phone": "+"}
#: Words [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ are the terms; a window reaches so many characters to either side.
TERM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
REACH, MIN_TERM = 80, 3
#: Ends of lines and sentences.
LINE_END = r"(?<=[.!?\n])"
GENERALISE, REMOVE, SUPPORT = 0.6, 0.9, 2


def _beside(gap: Column, after: bool) -> Column:
    """``REACH`` characters of a gap after or before a match, and the rest of a word that the cut would go through."""
    n = F.length(gap) - REACH
    if after:
        side, edge, rest, word = F.left(gap, F.lit(REACH)), F.substring(gap, REACH, 1), F.right(gap, n), f"^{TERM}+"
    else:
        side, edge, rest, word = F.right(gap, F.lit(REACH)), gap.substr(n + 1, F.lit(1)), F.left(gap, n), f"(?:^|(?<={TERM_GAP[:-1]})){TERM}+$"
    rest = F.when((n > 0) & edge.rlike(TERM), F.regexp_extract(rest, word, 0)).otherwise(F.lit(""))
    return F.concat(side, rest) if after else F.concat(rest, side)


def pieces(text: Column, pattern: str, kind: str, sides: bool = True) -> Column:
    """All matches in order, each with the length of the gap before it and, with ``sides``, the text beside it (of its gaps).

    The places follow by sums of lengths, so the work is linear however many matches a text holds.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.when(F.size(found) > 0, F.array(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g")))).otherwise(F.array())
    return F.flatten(F.transform(both, lambda x: F.transform(x["m"], lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(x["g"], i)).alias("gap"), m.alias("value"),
        *([_beside(F.get(x["g"], i), False).alias("left"), _beside(F.get(x["g"], i + 1), True).alias("right")] if sides else [])))))


def placed(matches: DataFrame, keys: list[str], offset: Column | int = 0) -> DataFrame:
    """Rows of ``pieces`` with start and end in code points, ``offset`` added."""
    upto = Window.partitionBy(*keys, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(upto) + offset
    return matches.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("value")).cast("int"))


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def step(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The check that a match must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def holds(kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, _holds(k, value)).otherwise(out)
    return out


def distinct_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """The lines and sentences of all texts, each once for every pair of neighbours it stands between."""
    text = F.col(text_col)
    at = lambda s, i: F.coalesce(F.get(s, i), F.lit(""))
    units = F.flatten(F.transform(F.array(F.split(text, LINE_END, -1)), lambda s: F.transform(s, lambda x, i: F.struct(
        F.xxhash64(at(s, i - 1), x, at(s, i + 1)).alias("beside"), x.alias("line")))))
    return docs.where(F.col(text_col) != "").select(F.explode(units).alias("u")).select("u.*").where(F.col("line") != "").distinct()


def _rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None,
         generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, keep_text: bool = False) -> DataFrame:
    """One row per document: row, doc_id, base (spans of the patterns), terms (added spans with disclosure and action).

    ``keep_text`` carries the text along, for those who rewrite it.
    """
    root = root or scratch_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_kind = [F.when(F.contains(text, F.lit(NEEDS[k])), pieces(text, p, k)).otherwise(F.array()) if k in NEEDS else pieces(text, p, k) for k, p in PATTERNS.items()]
    text_too = ["text"] if keep_text else []
    kept = F.col("text") if keep_text else F.when(F.size("matches") > 0, F.col("text"))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), F.concat(*by_kind).alias("matches"))
    base = materialize(base.select("row", "doc_id", kept.alias("text"), "matches"), "base", root)
    spans = placed(base.where(F.size("matches") > 0).select("row", F.explode("matches").alias("m")).select("row", "m.*"), ["row"])
    spans = materialize(spans.where(holds(F.col("kind"), F.col("value"))).withColumn("r", _rank(F.col("kind"))).drop("i", "gap"), "spans", root)

    # Every word of the distinct lines, counted; the first word of a line carries the line's length.
    lines = distinct_lines(docs, text_col).select(F.length("line").alias("n"), F.posexplode(F.split("line", TERM_GAP)).alias("at", "term"))
    counts = lines.withColumn("term", F.lower("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.sum(F.when(F.col("at") == 0, F.col("n")).otherwise(0)).alias("chars"))
    counts = materialize(counts, "words", root)
    n_words = counts.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    counts = counts.where(F.length("term") >= MIN_TERM).drop("chars")

    # Terms beside entities: at most as many as a window has words.
    entity = F.xxhash64(F.concat(F.col("kind"), F.lit(":"), F.lower(F.regexp_replace("value", r"[\x20().-]", ""))))
    spans = spans.withColumn("entity", entity)
    near = spans.select("entity", F.xxhash64("left", "right").alias("seen"), F.explode(F.concat(F.split("left", TERM_GAP), F.split("right", TERM_GAP))).alias("term"))
    near = near.select("entity", "seen", F.lower("term").alias("term")).where(F.length("term") >= MIN_TERM).distinct()
    near = materialize(near, "near", root)

    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support)
    n_c = near.select("entity", "seen").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    pairs = materialize(pairs.join(n_c, "entity"), "pairs", root)
    terms = pairs.select("term").distinct()
    known = materialize(counts.join(terms, "term", "left_semi"), "counts", root)
    total = n_words.first()["chars"]
    windows = max(2.0, total / (2.0 * REACH))
    n = F.lit(float(windows))
    pmi = F.log2(F.col("n_ct") * n / (F.col("n_c") * F.greatest(F.col("cf"), F.col("n_ct"))))
    ic = -F.log2(F.least(F.col("n_c") / n, F.lit(0.5)))
    strong = pairs.join(known, "term").withColumn("disclosure", F.least(pmi / ic, F.lit(1.0))).where(F.col("disclosure") >= generalise)
    strong = materialize(strong.select("entity", "term", F.round("disclosure", 6).alias("disclosure")), "strong", root)

    # Every place of a strong term in the documents that hold its entity, but for those that touch an entity: with both in
    # order, an entity touches a term if one that begins no later reaches into it, or the next one begins in it.
    marks = spans.select("row", "entity").distinct().join(strong, "entity").groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    marks = materialize(marks, "marks", root)
    texts = base.select("row", "text").join(marks.select("row").distinct(), "row", "left_semi")
    added = placed(texts.select("row", F.explode(pieces(F.col("text"), TERM, "term", sides=False)).alias("m")).select("row", "m.*"), ["row"])
    added = added.select("row", "start", "end", F.lower("value").alias("term")).join(marks, ["row", "term"])
    beside = spans.join(marks.select("row").distinct(), "row", "left_semi").select("row", "start", "end", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("disclosure"))
    both = added.select(beside.columns).unionByName(beside)
    is_entity, up, down = F.col("term").isNull(), Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.col("start").desc())
    both = both.withColumn("reach", F.max(F.when(is_entity, F.col("end"))).over(up)).withColumn("next", F.min(F.when(is_entity, F.col("start"))).over(down))
    added = both.where(~is_entity & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    added = added.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("term").alias("value"), "disclosure"))).alias("added"))
    listed_base = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "r", "end", "kind", "value"))).alias("found"))
    out = base.select("row", "doc_id", *text_too).join(listed_base.join(added, "row", "left"), "row", "left")
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:int,r:int,end:int,kind:string,value:string>>"))
    terms = F.coalesce(F.col("added"), F.array().cast("array<struct<start:int,end:int,value:string,disclosure:double>>"))
    out = out.select("row", "doc_id", *text_too, found.alias("base"), terms.alias("terms"))
    terms = F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS)).alias("r"), t["end"].alias("end"), F.lit("term").alias("kind"), t["value"].alias("value"),
        t["disclosure"].alias("disclosure"), F.when(t["disclosure"] >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("action")))
    return out.withColumn("terms", terms)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text): entities become their kind in brackets, terms go or become [word] or [number]."""
    found = find(docs, id_col, text_col, keep_text=True, **options)
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("by"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
            F.when(s["action"] == "remove", F.lit("")).when(s["value"].rlike("^[0-9]+$"), F.lit("[number]")).otherwise(F.lit("[word]")).alias("by"))),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        skip = m["start"] < acc["at"]  # overlaps what was replaced: the longer reach is dropped too
        return F.struct(
            F.greatest(acc["at"], m["end"]).alias("at"),
            F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, m["start"] - acc["at"]), m["by"])).alias("out"),
        )

    clean = F.aggregate(F.array_sort(marks), zero, step, lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))))
    return found.select("doc_id", clean.alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of op1."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    plain = F.transform("terms", lambda t: F.struct(*[t[k].alias(k) for k in ("start", "r", "end", "kind", "value")]))
    return found.select(
        "doc_id", *[number(k) for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat(F.col("base"), plain))).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
