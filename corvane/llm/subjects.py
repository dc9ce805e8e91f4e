"""Subject areas of documents, from labelling functions over their statements.

A document is cut into statements: sentences, list lines and table rows.  Four
labelling functions vote on each, independently of one another:

* lexicon: the words and word pairs of the statement; it votes for an area, or for none,
* address: the words of the symbol that a list line is about,
* section: the area that the other statements of its section treat, if it is only one,
* source: the area that prevails in documents of its source.

What words say about areas is learned, in any language: from a bounded sample of
documents labelled by hand and from the descriptions of the areas first, then in rounds
over the whole corpus, which alternate between the areas of a document, given what its
words tell, and what each word tells, given the areas of the documents that hold it.
There is no list of words.  How far each labelling function can be trusted is then
learned without labels, from how often votes agree, by a latent model over the counts
of vote patterns; its posteriors decide the area of each statement.  A document has the
areas of at least three of its statements.

All of it but the fit on vote patterns, which are bounded by the areas, is joins and
sums over tables: statements recur once their symbols and numbers are left out, so what
words tell is computed once for each distinct statement.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop
from ..plans.spread import spread
from .mixing import source_name

#: Labelled documents used to fit, rounds over the corpus, and areas at most.
MAX_LABELLED, ROUNDS, MAX_SUBJECTS = 20_000, 6, 100
#: The rounds end once the areas' shares of the corpus move by less than this altogether.
SETTLED = 0.001
#: Statements that make an area of a document.
STATEMENTS = 3
#: Weight, in documents, of the even distribution that a feature's areas are drawn to, and the share that makes it tell an area.
SHRINK, TELLING = 2.0, 0.55
#: Sums of statements from which an area of a document is more than a remark, and posteriors that are not passed on.
REMARK, NEGLIGIBLE = 1.5, 1e-3
#: Weight, in documents, of the even share that a source's areas are drawn to.
SOURCE = 20.0
#: Posterior from which the words of a statement settle its area; below it they leave it open.
FIRM, OPEN = 0.9, -1

# Patterns are free of repeated groups over whole texts, which would recurse on long ones.
_BREAK = r"(?i)</?(?:p|li|ul|ol|td|tr|table|h\d|div|br|pre|blockquote)\b[^>]{0,200}>"
_TAG = r"<[^>\n]{1,200}>"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
_HEADING = r"(?m)^[ \t]*#.*$"
_RULE = r"(?m)^[|:\- \t]+$"
_LEAD = r"(?m)^[ \t>]*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|\|[ \t]*\d+[ \t]*\||\|)?[ \t]*"
_TRAIL = r"(?m)[ \t]*\|?[ \t]*$"
_SENTENCE = r"(?<=[.?!])[\"')\]]{0,3}\s+(?=\S)|\s+(?=- `)|(?<=[a-z])\s+(?=\[\d\d:\d\d\])"
_NAME = r"(?:[A-Za-z]\w*_\w+|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)"
_LISTED = rf"\s*(?:[-*+•]\s*`?|`){_NAME}`?\s+(?:\p{{L}}+\s+){{1,3}}`?{_NAME}`?"
_SYMBOL = r"`[^`\n]{1,120}`|\b\w+_\w+\b|\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*\b|\b0[xX][0-9a-fA-F]+\b|\b\d[\w.]*\b"
_SNAKE = r"\b([a-z][a-z0-9]*_[a-z0-9_]*)\b"
_WORD = r"(\p{L}+(?:['-]\p{L}+){0,8})"


def _sections(text: Column) -> Column:
    """The parts between headings, as one text each with a statement a line; table heads and rules are none."""
    t = text
    plain = t
    for entity, char in _ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    t = F.when(F.contains(t, F.lit("&")), plain).otherwise(t)
    t = F.when(F.contains(t, F.lit("<")), F.regexp_replace(F.regexp_replace(t, _BREAK, "\n"), _TAG, " ")).otherwise(t)
    t = F.when(F.contains(t, F.lit("#")), F.regexp_replace(t, _HEADING, "\u0002")).otherwise(t)
    t = F.when(F.contains(t, F.lit("|")), F.regexp_replace(t, _RULE, "")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, _LEAD, ""), _TRAIL, "")
    t = F.regexp_replace(t, _SENTENCE, "\n")
    t = F.regexp_replace(t, rf"(?m)^({_LISTED})[ .,;|]+(?=\S)", "$1\n")
    return F.split(t, "\u0002")


def statements(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` without ``text``, with a row (section, statement) for each statement of the whole text; null texts have none."""
    kept = [c for c in documents.columns if c != text]
    parts = documents.select(*kept, F.posexplode(_sections(F.col(text))).alias("section", "_part"))
    return parts.select(*kept, "section", F.explode(F.split("_part", "\n+")).alias("statement")).filter(F.col("statement").rlike(r"[^ \t|\-]"))


def kinds(rows: DataFrame) -> DataFrame:
    """``rows`` with the kind of each ``statement``: (shape, symbols, listed).

    ``shape`` is its text without symbols and numbers, in lower case; ``symbols`` are the
    words of the symbols it names, and of a list line about a symbol (``listed``) those of
    that symbol alone.
    """
    s = F.col("statement")
    shape = F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, _SYMBOL, " ")), r"[^\p{L}'-]+", " "))
    first = F.regexp_extract(s, rf"^\W*({_NAME})", 1)
    named = F.when(F.col("listed"), F.array(F.lower(first))).when(F.contains(s, F.lit("_")), F.regexp_extract_all(s, F.lit(_SNAKE), 1)).otherwise(F.array().cast("array<string>"))
    listed = rows.withColumn("listed", F.contains(s, F.lit("_")) & s.rlike(rf"^{_LISTED}\W*$") | s.startswith("`") & s.rlike(rf"^{_LISTED}\W*$"))
    return listed.withColumn("shape", F.when(F.col("listed"), "").otherwise(shape)).withColumn("symbols", F.array_join(named, "_")).drop("statement")


def features(types: DataFrame) -> DataFrame:
    """(tid, fid, symbol): the words and word pairs of each kind's shape, and the words of its symbols, as hashes."""
    words = F.regexp_extract_all("shape", F.lit(_WORD), 1)
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    syms = F.filter(F.split("symbols", "_"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    both = F.concat(F.transform(F.array_distinct(F.concat("w", pairs)), lambda x: F.struct(F.xxhash64(x).alias("fid"), F.lit(False).alias("symbol"))), F.transform(F.array_distinct(syms), lambda x: F.struct(F.xxhash64(F.concat(F.lit("\u0001"), x)).alias("fid"), F.lit(True).alias("symbol"))))
    return types.withColumn("w", words).select("tid", F.explode(both).alias("f")).select("tid", "f.fid", "f.symbol")


def _sums(k: int, area: str, value: str) -> Column:
    """Aggregate: the sums of ``value`` by area, as an array."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col(area) == i, F.col(value))), F.lit(0.0)) for i in range(k)])


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def learned(masses: DataFrame, base: np.ndarray) -> DataFrame:
    """(fid, odds): what each feature says about areas, as log odds over an even share; only features that tell one.

    ``masses`` has (fid, area, m), the areas of the documents that hold a feature.  Features
    of general remarks and of phrases that any area uses are spread evenly and tell none,
    in whatever language.
    """
    k = len(base)
    held = masses.groupBy("fid").agg(_sums(k, "area", "m").alias("m"))
    rate = F.zip_with("m", F.array(*[F.lit(float(b)) for b in base]), lambda m, b: m / b)  # areas of many documents do not tell more
    x = held.select("fid", rate.alias("r"), _total(F.col("m")).alias("n")).filter("n > 0").withColumn("sum", _total(F.col("r")))
    q = x.select("fid", F.transform("r", lambda r: (r * F.col("n") / F.col("sum") + SHRINK / k) / (F.col("n") + SHRINK)).alias("q"))
    return q.filter(F.array_max("q") >= TELLING).select("fid", F.transform("q", lambda v: F.log(v * k)).alias("odds"))


def _softmax(x: Column) -> Column:
    raw = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(raw, lambda v: v / _total(raw))


def posteriors(held: DataFrame, odds: DataFrame, k: int) -> DataFrame:
    """(tid, p, word, symbol): posterior over areas of each kind that anything tells of, and the areas its words and its symbols alone tell (null if none, OPEN if words leave open which)."""
    joined = held.join(odds, "fid")
    sums = [F.sum(F.when(F.col("symbol") == side, F.get("odds", F.lit(i))).otherwise(0.0)).alias(f"{name}{i}") for name, side in (("w", False), ("s", True)) for i in range(k)]
    got = joined.groupBy("tid").agg(*sums, F.bool_or(~F.col("symbol")).alias("has_w"), F.bool_or("symbol").alias("has_s"))
    w, s = F.array(*[F.col(f"w{i}") for i in range(k)]), F.array(*[F.col(f"s{i}") for i in range(k)])
    top = lambda x: F.array_position(x, F.array_max(x)) - 1
    arrays = got.select("tid", w.alias("w"), s.alias("s"), "has_w", "has_s").withColumn("x", F.zip_with("w", "s", lambda a, b: a + b))
    return arrays.select("tid", _softmax(F.col("x")).alias("p"), F.when(F.col("has_w"), F.when(F.array_max(_softmax(F.col("w"))) >= FIRM, top(F.col("w"))).otherwise(OPEN)).cast("int").alias("word"), F.when(F.col("has_s"), top(F.col("s"))).cast("int").alias("symbol"))


def _spread_out(p: DataFrame) -> DataFrame:
    """(tid, area, p) of the posteriors that count."""
    return p.select("tid", F.posexplode("p").alias("area", "p")).filter(F.col("p") > NEGLIGIBLE)


def document_areas(rows: DataFrame, sparse: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, area, share) of the documents whose words tell areas; half of a labelled document is its label's.

    An area of one statement alone is a remark, unless the document has no other.
    """
    whole = rows.join(sparse, "tid").groupBy("doc_id", "area").agg(F.sum("p").alias("n"))
    lists = whole.groupBy("doc_id").agg(F.collect_list(F.struct("area", "n")).alias("a"))  # one entry an area
    strong = F.filter("a", lambda x: x["n"] >= REMARK)
    kept = lists.select("doc_id", F.when(F.size(strong) > 0, strong).otherwise(F.col("a")).alias("a"))
    shares = kept.select("doc_id", F.explode("a").alias("x"), F.aggregate("a", F.lit(0.0), lambda t, x: t + x["n"]).alias("t")).select("doc_id", "x.area", (F.col("x.n") / F.col("t")).alias("share"))
    known = labelled.select("doc_id", F.lit(0.5).alias("_half"))
    halved = shares.join(F.broadcast(known), "doc_id", "left").select("doc_id", "area", (F.col("share") * F.coalesce("_half", F.lit(1.0))).alias("share"))
    return halved.unionByName(labelled.select("doc_id", "area", F.lit(0.5).alias("share")))


ABSTAIN = -1
FUNCTIONS = ("lexicon", "address", "section", "source")


class Trust:
    """A latent class behind the votes of a statement; how often each function hits it is learned from agreement.

    A class is an area together with whether the statement treats it or is a general
    remark among statements that do.  What a section or source treats says of which area
    a statement is, not whether it is a general remark, so their votes have the same
    rates in both; those of lexicon and address differ.  Whether a function votes at all
    says nothing.  Rates start from expectations that weigh as much as ``START`` statements.
    """

    START = 50.0
    #: Functions whose votes tell a statement of an area from a general remark.
    OWN = (0, 1)

    def __init__(self, areas: int) -> None:
        self.k = areas
        self.prior = np.full((2, areas), 0.5 / max(areas, 1))
        #: P(votes the area) and P(votes none), first on statements of an area, then on general remarks around them; the rest errs evenly.
        self.first = np.array([[[0.95, 0.03], [0.0, 0.97]], [[0.93, 0.02], [0.0, 0.5]], [[0.8, 0.0], [0.8, 0.0]], [[0.2, 0.0], [0.2, 0.0]]])
        self.first[list(self.OWN), 1, 0] = (1 - self.first[list(self.OWN), 1, 1]) / max(areas, 1)
        self.rate = self.first.copy()

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """(pattern, treated 0 or general 1, area)."""
        x = np.tile(np.log(self.prior), (len(patterns), 1, 1))
        areas = np.arange(1, self.k + 1)[None, :]
        for j in range(patterns.shape[1]):
            v = patterns[:, j : j + 1]
            for c in (0, 1):
                hit, none = np.clip(self.rate[j, c], 1e-4, 1 - 1e-4)
                wrong = max(1 - hit - none, 1e-4) / max(1, self.k - 1)
                p = np.where(v == 0, none, np.where(v == areas, hit, wrong))
                x[:, c] += np.where(v == ABSTAIN, 0.0, np.log(p))
        x = np.exp(x - x.max(axis=(1, 2), keepdims=True))
        return x / x.sum(axis=(1, 2), keepdims=True)

    def fit(self, patterns: np.ndarray, n: np.ndarray, rounds: int = 25) -> Trust:
        """From distinct vote patterns and how many statements have each."""
        voted = (patterns != ABSTAIN).any(axis=1) if len(patterns) else np.zeros(0, bool)
        if not voted.any():
            return self
        for _ in range(rounds):
            post = self.posterior(patterns) * n[:, None, None]
            self.prior = (post[voted].sum(axis=0) + 1) / (post[voted].sum() + 2 * self.k)
            for j in range(patterns.shape[1]):
                v = patterns[:, j]
                seen = np.array([[sum(post[v == a, c, a - 1].sum() for a in range(1, self.k + 1)), post[v == 0, c].sum(), post[v != ABSTAIN, c].sum()] for c in (0, 1)])
                if j not in self.OWN:
                    seen[:] = seen.sum(axis=0)
                self.rate[j] = (seen[:, :2] + self.START * self.first[j]) / (seen[:, 2:] + self.START)
                if j in self.OWN:  # on general remarks they err evenly: a vote for the area around is no error of theirs
                    self.rate[j, 1, 0] = (1 - self.rate[j, 1, 1]) / self.k
        return self


def votes(rows: DataFrame, types: DataFrame, post: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(doc_id, v0 .. v3, n): the votes of lexicon, address, section and source on the statements of each document.

    0 is a vote for a general remark, area + 1 one for an area, ABSTAIN none.  ``rows`` has
    (doc_id, section, tid, n), ``places`` (doc_id, section, whole, source_vote) with the sums
    of posteriors of a section.
    """
    t = types.join(post, "tid", "left")
    has_words, has_symbols = F.col("shape") != "", F.col("symbols") != ""
    lexicon = F.when(F.col("word") == OPEN, ABSTAIN).when(F.col("word").isNotNull(), F.col("word") + 1).when(has_words, 0).otherwise(ABSTAIN)
    address = F.when(F.col("listed") & F.col("symbol").isNotNull(), F.col("symbol") + 1).when(F.col("listed") & has_symbols, 0).otherwise(ABSTAIN)
    t = t.select("tid", lexicon.alias("v0"), address.alias("v1"), F.coalesce("p", F.array(*[F.lit(0.0)] * k)).alias("p"))
    each = rows.join(t, "tid").join(places, ["doc_id", "section"], "left")
    rest = F.zip_with("whole", "p", lambda a, b: a - b)
    section = F.when(F.size(F.filter(rest, lambda x: x >= REMARK)) == 1, F.array_position(rest, F.array_max(rest))).otherwise(ABSTAIN)
    each = each.withColumn("v2", F.coalesce(section, F.lit(ABSTAIN)).cast("int")).withColumn("v3", F.coalesce("source_vote", F.lit(ABSTAIN)))
    return each.groupBy("doc_id", "v0", "v1", "v2", "v3").agg(F.sum("n").alias("n"))


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame, least: int = STATEMENTS, without: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Areas (doc_id, subject, statements) and how each labelling function fared (function, hit, none, right_none: its rates on statements of an area, and of no vote on general remarks).

    ``documents`` has (doc_id, text, source), ``subjects`` (subject, scope), scope may be
    absent, ``labels`` (doc_id, subject), of which at most MAX_LABELLED, chosen by hash, are
    used.  Null, blank and short texts have no area.  Without labels the descriptions of
    the areas alone start the rounds.  At most MAX_SUBJECTS areas.  ``without`` names
    labelling functions that are left out.
    """
    spark = documents.sparkSession
    listed = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().limit(MAX_SUBJECTS + 1).collect()]
    if len(listed) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} areas")
    names = sorted(listed)
    k = len(names)
    if not names:
        return spark.createDataFrame([], "doc_id bigint, subject string, statements bigint"), spark.createDataFrame([], "function string, hit double, none double, right_none double")
    number = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").filter("doc_id is not null and text is not null")
    said = kinds(statements(spread(docs, "doc_id"), "text")).withColumn("tid", F.xxhash64("shape", "symbols", "listed"))
    rows = cut(said.groupBy("doc_id", "source", "section", "tid", "shape", "symbols", "listed").agg(F.count("*").alias("n")))
    types = cut(rows.select("tid", "shape", "symbols", "listed").distinct())
    held = cut(features(types))
    # the bounded sample of labels, one per document, in the order of a hash
    sample = labels.filter(F.col("subject").isin(names)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("subject").alias("subject")).filter("doc_id is not null")
    labelled = cut(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select("doc_id", number[F.col("subject")].alias("area")))
    pairs = rows.select("doc_id", "tid")

    def base_of(areas: DataFrame) -> np.ndarray:
        base = np.ones(k)
        for r in areas.groupBy("area").agg(F.sum("share").alias("s")).collect():
            base[r["area"]] += r["s"]
        return base / base.mean()

    def masses(areas: DataFrame) -> DataFrame:
        by_type = pairs.join(areas, "doc_id").groupBy("tid", "area").agg(F.sum("share").alias("m"))
        return held.join(by_type, "tid").groupBy("fid", "area").agg(F.sum("m").alias("m"))

    scope = F.concat_ws(". ", F.translate("subject", "_", " "), *(["scope"] if "scope" in subjects.columns else []))
    about = subjects.filter("subject is not null").select(number[F.col("subject")].alias("area"), scope.alias("text"))
    about = features(kinds(statements(about, "text")).withColumn("tid", F.col("area"))).select("fid", F.col("tid").cast("int").alias("area"), F.lit(1.0).alias("m"))
    known = labelled.select("doc_id", "area", F.lit(1.0).alias("share"))
    odds, base = cut(learned(masses(known).unionByName(about), base_of(known))), None
    for i in range(ROUNDS):
        post = cut(posteriors(held, odds, k))
        areas = cut(document_areas(pairs, _spread_out(post), labelled))
        before, base = base, base_of(areas)
        if i == ROUNDS - 1 or (before is not None and np.abs(base - before).sum() < SETTLED * k):
            break
        odds_next = cut(learned(masses(areas), base))
        drop(odds, post, areas)
        odds = odds_next
    # a source votes for an area that it treats at least twice as often as an even share; a source of few documents has the area of each by itself
    by_source = areas.join(rows.select("doc_id", "source").distinct(), "doc_id").filter("source is not null").groupBy("source").agg(_sums(k, "area", "share").alias("v"))
    source = by_source.filter(F.array_max("v") + SOURCE / k > (_total(F.col("v")) + SOURCE) * (2.0 / k)).select("source", F.array_position("v", F.array_max("v")).cast("int").alias("source_vote"))
    whole = rows.join(_spread_out(post), "tid").groupBy("doc_id", "section", "source", "area").agg(F.sum(F.col("p") * F.col("n")).alias("m")).groupBy("doc_id", "section", "source").agg(_sums(k, "area", "m").alias("whole"))
    places = whole.join(source, "source", "left").select("doc_id", "section", "whole", "source_vote")
    cast = cut(votes(rows.select("doc_id", "section", "tid", "n"), types, post, places, k))
    v = [f"v{j}" for j in range(len(FUNCTIONS))]
    for j, f in enumerate(FUNCTIONS):
        if f in without:
            cast = cast.withColumn(v[j], F.lit(ABSTAIN))
    # as many patterns as there are combinations of classes at most
    seen = cast.groupBy(*v).agg(F.sum("n").alias("n")).orderBy(*v).collect()
    patterns = np.array([[r[c] for c in v] for r in seen], np.int64).reshape(len(seen), len(v))
    trust = Trust(k).fit(patterns, np.array([r["n"] for r in seen], float))
    treated = trust.posterior(patterns)[:, 0] if len(seen) else np.zeros((0, k))
    decided = [(*map(int, p), 1 + int(q.argmax())) for p, q in zip(patterns.tolist(), treated, strict=True) if q.max() > 0.5]
    says = spark.createDataFrame(decided, ", ".join(f"{c} int" for c in v) + ", area int")
    label = F.array(*[F.lit(s) for s in names])
    found = cast.join(F.broadcast(says), v).groupBy("doc_id", "area").agg(F.sum("n").alias("statements")).filter(F.col("statements") >= least)
    fared = [(f, *map(float, (*trust.rate[j, 0], trust.rate[j, 1, 1]))) for j, f in enumerate(FUNCTIONS)]
    return found.select("doc_id", F.element_at(label, F.col("area")).alias("subject"), "statements"), spark.createDataFrame(fared, "function string, hit double, none double, right_none double")
