"""Benchmark decontamination by template windows, DataFrame operations only.

Texts become words in two forms: plain (lower case, without punctuation) and
template, where numbers, units and names are typed placeholders.  Windows of
``width`` words are hashed; windows of the benchmark's items meet those of the
documents in a hash join, so a question is found with other numbers, units or
names too, also by names that begin a sentence (a second template form types every
capitalised word).  Windows dense in slots grow until they hold enough literals.
A template match has to fill the slots consistently: along one
alignment of item and document each item value stands for one document value;
two item values may stand for the same one.

Items shorter than a window match as a whole from ``least_words`` words on;
shorter ones match nothing.  The benchmark's windows are counted first and
broadcast only up to ``broadcast_windows``; above, both sides are shuffled as
narrow rows.  The words of the few matches are fetched afterwards.

Defined results: null and empty texts match nothing; repeated rows and ids each
give their rows; null ids are kept; empty tables give no rows; other columns do
not matter.  Every word of every document is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busweave.llm.candidates import possible, without
from busweave.operators.computed import with_computed
from busweave.session import settle

WIDTH = 8
LEAST_WORDS = 5
LEAST_LITERALS = 4
LEAST_SHARE = 0.3
LEAST_RUN = 5
BROADCAST_WINDOWS = 500_000
#: Begin words of the benchmark's windows that are tested before hashing; beyond, every window is hashed.
MOST_FIRST = 50_000

_STEPS = (12, 16, 24, 32, 48, 64, 96, 128)

# The typed placeholders (their mark occurs in no word) and the units they cover.
MARK = "\u241f"
NUMBER, UNIT, NAME = MARK + "number", MARK + "unit", MARK + "name"
UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|foot|feet|yd|yard|yards|mile|miles|mg|g|kg|t|lb|lbs|oz|ml|cl|l|"
    "liter|liters|litre|litres|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|"
    "weeks|month|months|year|years|kmh|mph|ms|hz|khz|mhz|ghz|w|kw|mw|v|kv|kj|kcal|joule|joules|"
    "degree|degrees|percent|dollar|dollars|euro|euros|cent|cents|usd|eur|gbp|kb|mb|gb|tb|°c|°f|%|€|\\$|£"
)

# Classes of single characters: ranges cost a call each, and these patterns read every text.
_PUNCTUATION = r"""[!"#&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
_SPACES = r"[\t\n\x0B\f\r]+\x20*|\x20[\x20\t\n\x0B\f\r]+"
_SPACE = r"[\x20\t\n\x0B\f\r]+"
_NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;]\x20.)\p{Ll}+(?=[\s\p{Punct}]|$)"
_CAPITALISED = r"(?<![^\s\p{Punct}])\p{Lu}\p{Ll}+(?=[\s\p{Punct}]|$)"
_NUMBER = r"(?<![^\x20])[$€£]?\p{N}+(%|€|\$|£|st|nd|rd|th)?(?![^\x20])"
_MEASURE = rf"(?<![^\x20])\p{{N}}+(?i:{UNITS})(?![^\x20])"
_UNIT = rf"(?<={NUMBER} )(?i:{UNITS})(?![^\x20])"
# Marks around capitalised words; like the placeholders' mark they occur in no word.
_OPEN, _CLOSE = "\u2420", "\u2421"
_MARKED_UNIT = rf"(?<={NUMBER} )({_OPEN}?)(?i:{UNITS})({_CLOSE}?)(?![^\x20])"


def _words(text: Column) -> Column:
    """Lower-case words without punctuation; the first and last may be empty."""
    return F.split(F.lower(F.trim(F.regexp_replace(text, _PUNCTUATION, ""))), _SPACE, -1)


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, _SPACES, " ")


def _typed_words(text: Column, name: str = _NAME) -> Column:
    """The same words with placeholders for numbers, units and names."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(_squeezed(text), name, NAME), _PUNCTUATION, ""))
    typed = F.regexp_replace(F.regexp_replace(bare, _SPACES, " "), _MEASURE, NUMBER + UNIT)
    typed = F.regexp_replace(F.regexp_replace(typed, _NUMBER, NUMBER), _UNIT, UNIT)
    return F.split(F.lower(typed), _SPACE, -1)


def _forms(raw: DataFrame) -> DataFrame:
    """(doc_id, tk, form, words): every form of every text, each text read once.

    The typed and the bold form differ in capitalised words that are no names by
    their place.  These get marks around them, so that all patterns run once for
    both forms; in the end the typed form drops the marks, and the bold form what
    is between them.  Each step is a layer of its own, so that no pattern runs
    twice.  Forms without a placeholder match no template and are left out.
    """
    keep = ["doc_id", "tk"]
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = with_computed(raw, {"__plain": _words(body), "__squeezed": _squeezed(body)}, keep=keep)
    keep = [*keep, "__plain"]
    named = F.regexp_replace(F.col("__squeezed"), _NAME, NAME)
    marked = F.regexp_replace(named, _CAPITALISED, f"{_OPEN}$0{_CLOSE}")
    rows = with_computed(rows, {"__t": F.trim(F.regexp_replace(marked, _PUNCTUATION, ""))}, keep=keep)
    text = F.col("__t")
    rows = with_computed(
        rows, {"__t": F.when(text.contains("  "), F.regexp_replace(text, _SPACES, " ")).otherwise(text)}, keep=keep
    )
    numbered = F.regexp_replace(F.regexp_replace(text, _MEASURE, NUMBER + UNIT), _NUMBER, NUMBER)
    numbered = F.regexp_replace(numbered, _MARKED_UNIT, f"$1{UNIT}$2")
    has_numbers = text.rlike(r"\p{N}") | text.contains(NUMBER)
    rows = with_computed(rows, {"__t": F.lower(F.when(has_numbers, numbered).otherwise(text))}, keep=keep)
    typed = F.replace(F.replace(text, F.lit(_OPEN), F.lit("")), F.lit(_CLOSE), F.lit(""))
    bold = F.regexp_replace(text, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", NAME)
    placed = text.contains(MARK)
    rows = with_computed(
        rows,
        {"__typed": F.when(placed, F.split(typed, _SPACE, -1)),
         "__bold": F.when(placed | text.contains(_OPEN), F.split(bold, _SPACE, -1))},
        keep=keep,
    )
    form = lambda name: F.struct(F.lit(name).alias("form"), F.col(f"__{name}").alias("words"))
    return rows.select("doc_id", "tk", F.inline(F.array(form("plain"), form("typed"), form("bold")))).filter(
        "words IS NOT NULL"
    )


def _hash(places: list[Column], window: Column) -> Column:
    """Hash of a window's words; of long windows as an array, which keeps the generated code small."""
    return F.xxhash64(*places) if len(places) <= 2 * WIDTH else F.xxhash64(window)


def _hash_of(words: str, at: Column, size: Column, sizes: list[int]) -> Column:
    """Hash of the window of ``size`` words at ``at``."""
    found = F.lit(None).cast("long")
    for n in sizes:
        places = [F.get(F.col(words), at + j) for j in range(n)]
        found = F.when(size == n, _hash(places, F.slice(words, at + 1, n))).otherwise(found)
    return found


def _windows(forms: DataFrame, sizes: dict[str, list[int]], first: dict[tuple[str, int], list[str]] | None) -> DataFrame:
    """(doc_id, tk, form, size, at, hash): one row per window that may match.

    ``first`` are the words that begin the benchmark's windows of a form and size;
    a window that begins with another one cannot match.  Plain column expressions
    over the exploded positions, so that the words stay where they are and
    explode, hash and join run in one generated loop.
    """
    word = F.col("__word")
    rows = forms.select("doc_id", "tk", "form", "words", F.posexplode("words").alias("at", "__word"))
    if first is not None:
        rows = rows.filter(word.isin(sorted({w for some in first.values() for w in some})))
    wide = F.lit(None).cast("array<int>")
    for form, some in sizes.items():
        begun = lambda n: F.lit(n) if first is None else F.when(word.isin(first[form, n]), F.lit(n))  # noqa: B023, E731
        wide = F.when(F.col("form") == form, F.array(*[begun(n) for n in some])).otherwise(wide)
    rows = rows.select("doc_id", "tk", "form", "words", "at", F.explode(wide).alias("size"))
    rows = rows.filter(F.col("at") <= F.size("words") - F.col("size"))
    every = sorted({n for some in sizes.values() for n in some})
    return rows.select(
        "doc_id", "tk", "form", "size", "at", _hash_of("words", F.col("at"), F.col("size"), every).alias("hash")
    )


def _template_windows(items: DataFrame, words: str, least: int) -> DataFrame:
    """Windows with slots, each grown until it holds ``least`` literals.

    A window grows to the right by steps, then to the left, up to the whole item;
    it stands for the place ``item_at`` of the window it grew from.
    """
    steps = F.array(*[F.lit(n) for n in _STEPS])
    sizes = F.array_distinct(F.concat(
        F.array("size"), F.filter(steps, lambda n: (n > F.col("size")) & (n < F.col("n_words"))), F.array("n_words")
    ))
    rows = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("size"))))

    def grown(n):
        start = F.greatest(F.lit(0), F.least(F.col("item_at"), F.col("n_words") - n))
        part = F.slice(words, start + 1, n)
        return F.struct(start.alias("start"), n.alias("size"), part.alias("item_typed"),
                        F.size(F.filter(part, lambda w: w.contains(MARK))).alias("marked"))

    fit = F.filter(F.transform(sizes, grown), lambda g: g["size"] - g["marked"] >= least)
    rows = rows.withColumn("g", F.get(fit, F.lit(0))).filter("g.marked > 0")
    return rows.select(
        "item_id", "n_item_windows", "item_at", "g.start", "g.size",
        F.slice("plain", F.col("g.start") + 1, F.col("g.size")).alias("item_plain"), "g.item_typed",
        F.slice("typed", F.col("g.start") + 1, F.col("g.size")).alias("narrow"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``contaminated_texts`` without the text hash."""
    return contaminated_texts(docs, benchmark, **options).drop("tk")


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
    item_text: str = "text", width: int = WIDTH, least_words: int = LEAST_WORDS,
    least_literals: int = LEAST_LITERALS, least_share: float = LEAST_SHARE, least_run: int = LEAST_RUN,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc_id, tk, item_id, offset, n_matched, n_item_windows, n_slots, changed).

    Matches are counted by (id, text hash ``tk``), so rows that share an id or
    have none are decided on their own.
    ``offset`` is the document position of the item's first word; ``changed``
    tells that numbers, units or names differ.  A pair counts if it matches
    ``least_run`` windows (all, if the item has fewer) or ``least_share`` of them.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("body"))
    items = with_computed(
        items, {"plain": _words(body), "typed": _typed_words(body), "bold": _typed_words(body, _CAPITALISED)}, keep=["item_id"]
    )
    items = items.withColumn("n_words", F.size("plain")).filter(F.col("n_words") >= least_words)
    items = items.withColumn("size", F.least("n_words", F.lit(width)))
    items = settle(items.withColumn("n_item_windows", F.col("n_words") - F.col("size") + 1), "benchmark-items")
    raw = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body")).withColumn("tk", F.xxhash64("body"))
    whole = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("size"))))
    whole = whole.select(
        "item_id", "n_item_windows", "item_at", F.col("item_at").alias("start"), "size",
        F.slice("plain", F.col("item_at") + 1, F.col("size")).alias("item_plain"),
        F.slice("typed", F.col("item_at") + 1, F.col("size")).alias("item_typed"),
    )
    wanted = whole.withColumn("form", F.lit("plain"))
    for words in ("typed", "bold"):
        grown = _template_windows(items, words, least_literals)
        if words == "bold":
            grown = grown.filter("item_typed <> narrow")
        wanted = wanted.unionByName(grown.drop("narrow").withColumn("form", F.lit(words)))
    part = F.when(F.col("form") == "plain", F.col("item_plain")).otherwise(F.col("item_typed"))
    own = settle(wanted.withColumn("__part", part), "benchmark-windows")
    sizes: dict[str, list[int]] = {}
    for r in own.select("form", "size").distinct().orderBy("form", "size").collect():
        sizes.setdefault(r.form, []).append(r.size)
    if not sizes:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {docs.schema[key].dataType.simpleString()}, tk long, "
            f"item_id {benchmark.schema[item].dataType.simpleString()}, "
            "offset int, n_matched long, n_item_windows int, n_slots long, changed boolean",
        )
    every = sorted({n for some in sizes.values() for n in some})
    wanted_hash = _hash_of("__part", F.lit(0), F.col("size"), every).alias("wanted")
    starts = own.select("form", "size", F.get("__part", F.lit(0)).alias("word")).distinct()
    begun = starts.limit(MOST_FIRST + 1).collect()
    first = {(form, n): [r.word for r in begun if (r.form, r["size"]) == (form, n)] for form, some in sizes.items() for n in some}
    own = settle(own.select(*[c for c in own.columns if c != "__part"], wanted_hash), "benchmark-hashes")
    count = own.count()
    own = own.withColumnsRenamed({"form": "__form", "size": "__size"})
    if count <= broadcast_windows:
        own = F.broadcast(own)
    found = _windows(_forms(raw), sizes, first if len(begun) <= MOST_FIRST else None)
    same = (F.col("hash") == F.col("wanted")) & (F.col("form") == F.col("__form")) & (F.col("size") == F.col("__size"))
    hits = found.join(own, same).drop("hash", "wanted", "__form", "__size").withColumnsRenamed({"doc_id": "__id", "tk": "__tk"})
    return _consistent(_with_words(raw, settle(hits, "benchmark-hits")), least_literals, least_share, least_run)


def _with_words(raw: DataFrame, hits: DataFrame) -> DataFrame:
    """The document's words beside each hit; a document's words are read once."""
    fields = [c for c in hits.columns if c not in ("__id", "__tk")]
    per_doc = hits.groupBy("__id", "__tk").agg(F.collect_set(F.struct(*fields)).alias("__hits"))
    joined = possible(raw, F.col("tk"), hits, "__tk").join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("tk").eqNullSafe(F.col("__tk")))
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = with_computed(joined, {"__plain": _words(body), "__typed": _typed_words(body), "__bold": _typed_words(body, _CAPITALISED)}, keep=["doc_id", "tk", "__hits"])
    full = F.transform(
        "__hits",
        lambda h: F.struct(
            *[h[c].alias(c) for c in fields],
            F.slice("__plain", h["at"] + 1, h["size"]).alias("plain"),
            F.when(h["form"] == "bold", F.slice("__bold", h["at"] + 1, h["size"]))
            .otherwise(F.slice("__typed", h["at"] + 1, h["size"])).alias("typed"),
        ),
    )
    return rows.select("doc_id", "tk", F.inline(full))


def _consistent(matches: DataFrame, least_literals: int, least_share: float, least_run: int) -> DataFrame:
    """Matches by alignment whose slots agree.

    Hash matches are confirmed on the words.  Each distinct (item value, document
    value) of an alignment is counted once; the mapping holds if no item value
    occurs in two pairs.  An alignment is judged without and with the windows in
    which words that begin a sentence are names, and the better result counts.
    """
    exact = F.col("plain") == F.col("item_plain")
    literals = F.size(F.filter("typed", lambda w: ~w.contains(MARK)))
    template = (F.col("typed") == F.col("item_typed")) & (literals >= least_literals)
    rows = matches.filter(exact | template).select(
        "doc_id", "tk", "item_id", (F.col("at") - F.col("start")).alias("offset"), "item_at",
        "n_item_windows", exact.alias("same"),
        F.explode(F.when(F.col("form") == "bold", F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("named"),
        F.when(
            ~exact,
            F.filter(
                F.arrays_zip("typed", F.col("item_plain").alias("item"), F.col("plain").alias("doc")),
                lambda w: w["typed"].contains(MARK),
            ),
        ).alias("slots"),
    )
    by = ["doc_id", "tk", "item_id", "offset", "n_item_windows", "named"]
    windows = rows.groupBy(*by, "item_at").agg(F.max("same").alias("same"), F.flatten(F.collect_set("slots")).alias("slots"))
    windows = settle(windows, "benchmark-matches")
    pairs = windows.filter("NOT same").select(*by, F.explode("slots").alias("slot")).select(
        *by, "slot.item", "slot.doc"
    ).distinct()
    agree = pairs.groupBy(*by).agg(
        F.count("*").alias("n_slots"), F.count_distinct("item").alias("a"),
        F.max((F.col("item") != F.col("doc")).cast("int")).alias("differs"),
    )
    summary = windows.groupBy(*by).agg(
        F.count("*").alias("n_all"), F.sum(F.col("same").cast("long")).alias("n_same")
    ).select(*[F.col(c).alias("_" + c) for c in by], "n_all", "n_same")
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in by]
    joined = summary.join(agree, same, "left")
    holds = F.col("n_slots").isNull() | (F.col("a") == F.col("n_slots"))
    counted = joined.select(
        *[F.col("_" + c).alias(c) for c in by],
        F.when(holds, F.col("n_all")).otherwise(F.col("n_same")).alias("n_matched"),
        F.when(holds, F.coalesce("n_slots", F.lit(0))).otherwise(0).cast("long").alias("n_slots"),
        F.coalesce(holds & (F.col("differs") == 1), F.lit(False)).alias("changed"),
    )
    best = F.max_by(F.struct("n_matched", "n_slots", "changed"), F.struct("n_matched", -F.col("named"))).alias("best")
    counted = counted.groupBy(*by[:-1]).agg(best).select(*by[:-1], "best.*")
    enough = (F.col("n_matched") >= F.least(F.lit(least_run), F.col("n_item_windows"))) | (
        F.col("n_matched") >= least_share * F.col("n_item_windows")
    )
    return counted.filter((F.col("n_matched") > 0) & enough).select(
        "doc_id", "tk", "item_id", "offset", "n_matched", "n_item_windows", "n_slots", "changed"
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options
) -> DataFrame:
    """Documents without a match; each row goes by its own id and text."""
    found = contaminated_texts(docs, benchmark, text=text, key=key, **options)
    found = settle(found.select(F.col("doc_id").alias("__hit"), F.col("tk").alias("__tk")).distinct(), "contaminated")
    same = F.col(key).eqNullSafe(F.col("__hit")) & (F.xxhash64(text) == F.col("__tk"))
    return without(docs, F.xxhash64(text), found, "__tk", same)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_decontamination": op1_decontamination}
