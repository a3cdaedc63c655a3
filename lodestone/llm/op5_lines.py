"""Line dedup [native]: an exact set-similarity join of lines on the rarest of their tokens; later matches go.

Lines are described in one pass: the size of their token set, a parity bitmap, and as prefix the rarest tokens, of which
two similar lines must share one. Only narrow rows of prefix tokens are shuffled; texts of lines follow for the few pairs
that pass the filters. Rarity is that of all lines: tokens are counted in a table of ``BUCKETS`` hash buckets, so two
tokens of one bucket share a count; that only affects the order, never which lines match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table, written

#: Hash buckets in which the uses of tokens are counted.
BUCKETS = 1 << 17
#: A prefix token of more lines than this is joined by way of its earliest line first, ...
HOT_LINES = 256
#: ... then with parts of at most about so many of its lines.
PART_LINES = 1 << 14
#: Prefix tokens are numbers; those from here on have enough uses to be hot.
MAYBE_HOT = 1 << 30
#: Bit of a token's key at which its level begins; the hash fills those below.
LEVEL_BIT = 56
#: Hot tokens up to these numbers are listed in the plan (both sides of the join then share a shuffle), or broadcast.
LISTED_TOKENS, BROADCAST_TOKENS = 20_000, 200_000
#: Lines of more tokens than this have a parity of 128 classes; others do with 64.
LONG_LINE = 80
#: Bits of the filter that picks the lines whose texts are needed (4 MB at most, however many lines).
FILTER_BITS = 1 << 25

_SPACES = "\t\r\f\x0b"
_LINE_KEY = "__line_key"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def words_of(line: Column) -> Column:
    """What white space parts; empty strings among the words."""
    other = line.contains(_SPACES[0])
    for space in _SPACES[1:]:
        other |= line.contains(space)
    return F.split(F.when(other, F.translate(line, _SPACES, " " * len(_SPACES))).otherwise(line), " ", -1)


def tokens_of(line: Column) -> Column:
    """Distinct words of a line."""
    return F.array_remove(F.array_distinct(words_of(line)), "")


def all_lines(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.posexplode(lines_of(F.col("text"))).alias("no", "line"))


def bucket_of(token_hash: Column) -> Column:
    return token_hash.bitwiseAND(F.lit(BUCKETS - 1))


def constants(numbers: list[int], kind: str) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def rarity_levels(lines: DataFrame) -> Column:
    """An array with the level of every bucket: twice the binary logarithm of the uses of its tokens in all lines."""
    tokens = lines.select(F.explode(words_of(F.col("line"))).alias("token"))
    counts = tokens.groupBy(bucket_of(F.xxhash64("token")).alias("bucket")).count().collect()
    levels = [0] * BUCKETS
    for bucket, n in counts:
        levels[bucket] = int(2 * math.log2(n))
    return constants(levels, "tinyint")


def described(lines: DataFrame, levels: Column, percent: int) -> DataFrame:
    """Every line with a word: 128 bits of hash that stand for it, the size ``n`` of its token set, parity, and prefix.

    The prefix holds the rarest ``n - ceil(percent * n) + 1`` tokens as they are ordered: a level above 56 bits of the hash.
    No null can be among them, so that arrays of numbers are sorted; levels come from few numbers, which stay in the
    processor's cache. The parity has a bit for each of 64 classes of tokens, set if the line has an
    odd number of them: sets that differ in d tokens differ in d bits at most. A long line has another for one half of the
    tokens, and so by their difference for the other half.
    """
    empty = F.xxhash64(F.lit(""))
    hashes = F.array_remove(F.array_distinct(F.transform(words_of(F.col("line")), lambda t: F.xxhash64(t))), empty)
    steps = constants([k << LEVEL_BIT for k in range(128)], "bigint")
    level = lambda h: F.coalesce(F.get(steps, F.get(levels, bucket_of(h))), F.lit(0).cast("long"))  # noqa: E731
    keys = F.sort_array(F.transform(hashes, lambda h: level(h).bitwiseOR(F.shiftrightunsigned(h, 64 - LEVEL_BIT))))
    bits = constants([-(1 << 63) if k == 63 else 1 << k for k in range(64)] + [0] * 64, "bigint")
    flip = lambda bit: F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(bit(k)))  # noqa: E731
    parity = flip(lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int")))
    half = flip(lambda k: F.get(bits, k.bitwiseAND(F.lit(127))))
    n = F.size("keys")
    prefix = F.slice("keys", 1, n - F.ceil(n * F.lit(percent) / 100 - F.lit(1e-9)).cast("int") + 1)
    return lines.where(F.col("line").rlike("[^\\s]")).withColumn("keys", keys).select(
        "id", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), n.alias("n"),
        parity.alias("parity"), F.when(n > LONG_LINE, half).otherwise(F.lit(0).cast("long")).alias("half"),
        prefix.alias("prefix"),
    )  # fmt: skip


def first_lines(docs: DataFrame, percent: int) -> DataFrame:
    """The first occurrence of every line with a word, described; of equal lines a task passes on one."""
    lines = all_lines(docs)
    described_lines = described(lines, rarity_levels(lines), percent)
    first = Window.partitionBy("h1", "h2").orderBy("id", "no")
    return described_lines.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("id", "no", "n", "parity", "half", "prefix")


def prefix_rows(lines: DataFrame) -> DataFrame:
    """A row for each prefix token of each line with its place in the order of the line.

    The token is 30 bits of its hash and one that says whether its bucket has the uses of a hot token.
    """
    rows = lines.select(F.posexplode("prefix").alias("pos", "key"), "id", "no", "n", "parity", "half")
    hot = F.when(F.col("key") >= F.lit(int(2 * math.log2(HOT_LINES)) << LEVEL_BIT), F.lit(MAYBE_HOT)).otherwise(F.lit(0))
    token = (F.col("key").bitwiseAND(F.lit(MAYBE_HOT - 1)) + hot).cast("int")
    return rows.select("pos", token.alias("token"), "id", "no", "n", "parity", "half")


def candidates(rows: DataFrame, others: DataFrame, on: list[str], percent: int) -> DataFrame:
    """``id, no, n, xid, xno, xn``: the rows and the earlier ones of ``others`` with the same key that the filters let through.

    By length and positions enough tokens may be common, and the parities differ in no more bits than the sets may. The
    join compares parities alone, since nearly all pairs fail there and it reads every column of its condition for each; a
    predicate that names the partition isn't moved into it, so the other columns are read for the pairs left.
    """
    a, b = rows.alias("a"), others.alias("b")
    both = F.col("a.n") + F.col("b.n")
    enough = lambda common: common * (100 + percent) >= both * percent  # noqa: E731
    ahead = F.least("a.pos", "b.pos") + 1 + F.least(F.col("a.n") - F.col("a.pos") - 1, F.col("b.n") - F.col("b.pos") - 1)
    differ = lambda c: F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))  # noqa: E731
    within = lambda apart: apart * (100 + percent) <= both * (100 - percent)  # noqa: E731
    halves = F.bit_count(differ("half")) + F.bit_count(differ("parity").bitwiseXOR(differ("half")))
    alike = (F.least("a.n", "b.n") <= LONG_LINE) | within(halves)
    earlier = (F.col("b.id") < F.col("a.id")) | ((F.col("b.id") == F.col("a.id")) & (F.col("b.no") < F.col("a.no")))
    length = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    same = F.col(f"a.{on[0]}") == F.col(f"b.{on[0]}")
    for c in on[1:]:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    joined = a.join(b, same & within(F.bit_count(differ("parity")))).where(F.when(F.spark_partition_id() >= 0, earlier & length & alike & enough(ahead)))
    return joined.select(*[F.col(f"{side}.{c}").alias(f"{name}{c}") for side, name in (("a", ""), ("b", "x")) for c in ("id", "no", "n")])


def paired(matches: DataFrame, percent: int, whole: bool = True) -> DataFrame:
    """The pairs ``id, no, xid, xno`` of prefix tokens that match. With ``whole`` all matches of a pair are there.

    Then tokens in common, as far as the prefix that ends first goes, are those that match; so at most as many more are
    common as follow that prefix.
    """
    pairs = matches.groupBy("id", "no", "n", "xid", "xno", "xn").count()
    after = lambda n: F.floor((F.col(n) * percent + 99) / 100) - 1  # noqa: E731
    most = F.col("count") + F.greatest(after("n"), after("xn"))
    if whole:
        pairs = pairs.where(most * (100 + percent) >= (F.col("n") + F.col("xn")) * percent)
    return written(pairs.select("id", "no", "xid", "xno"))


def among(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The ``rows`` that ``wanted`` has too by ``columns``, and a few others that a filter of fixed size lets through."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bits = written(wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, no, line`` and number of tokens ``n`` of the lines of ``pairs``, and of a few others; only their documents are split."""
    ends = pairs.select("id", "no").union(pairs.select("xid", "xno"))
    lines = among(all_lines(among(docs, ends, ["id"])), ends, ["id", "no"])
    return lines.select("id", "no", "line", F.size(tokens_of(F.col("line"))).alias("n"))


def similar(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``id, no`` of the first lines of the pairs that have the Jaccard similarity, by their whole token sets."""
    other = texts.select(F.col("id").alias("xid"), F.col("no").alias("xno"), F.col("line").alias("xline"), F.col("n").alias("xn"))
    both = pairs.join(texts, ["id", "no"]).join(other, ["xid", "xno"])
    common = F.size(F.array_remove(F.array_intersect(words_of(F.col("line")), words_of(F.col("xline"))), ""))
    return both.where(common * (100 + percent) >= (F.col("n") + F.col("xn")) * percent).select("id", "no").distinct()


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``id, no`` of the lines with a similar earlier line among their pairs.

    Each line is held against its earliest candidate first; only lines that fail it are held against all of theirs.
    """
    texts = written(texts_of(docs, pairs))
    earliest = pairs.groupBy("id", "no").agg(F.min(F.struct("xid", "xno")).alias("x")).select("id", "no", "x.xid", "x.xno")
    near = written(similar(earliest, texts, percent))
    rest = written(pairs.join(near, ["id", "no"], "left_anti").join(earliest, ["id", "no", "xid", "xno"], "left_anti"))
    return near if rest.isEmpty() else near.union(similar(rest, texts, percent))


def band_of(n: Column, percent: int) -> Column:
    """A number that grows with the length ``n`` of a line; most lengths are similar to those of two bands."""
    return F.floor(F.log(n.cast("double")) / max(0.1, 2 * math.log(100 / percent))).cast("int")


def bands_for(n: Column, percent: int) -> Column:
    """The bands of all lengths that a line similar to one of length ``n`` may have."""
    shortest, longest = F.ceil(n * percent / 100 - F.lit(1e-9)), F.floor(n * 100 / percent + F.lit(1e-9))
    return F.sequence(band_of(shortest, percent), band_of(longest, percent))


def near_matches(docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """``id, no`` of the lines among ``firsts`` (described) that are similar to an earlier one of them.

    Two lines of the similarity share a token among the prefixes of both. The lines of a hot token are held against its
    earliest line first, which settles the many variants of one line with a row each. Those left are joined with all lines
    of the token in the bands of lengths that theirs allows, dealt into parts of bounded size.
    """
    rows = prefix_rows(firsts)
    hot = written(rows.where(F.col("token") >= MAYBE_HOT).groupBy("token").count().where(F.col("count") > HOT_LINES))
    few = hot.count()
    if not few:
        return verified(docs, paired(candidates(rows, rows, ["token"], percent), percent), percent)
    marked = F.broadcast(hot) if few <= BROADCAST_TOKENS else hot
    warm = written(rows.join(marked, "token"))
    cold = rows.where(~F.col("token").isin([r.token for r in hot.collect()])) if few <= LISTED_TOKENS else rows.join(marked, "token", "left_anti")
    seeds = warm.groupBy("token").agg(F.min(F.struct("id", "no", "n", "pos", "parity", "half")).alias("s")).select("token", "s.*")
    near = written(verified(docs, paired(candidates(warm, seeds, ["token"], percent), percent, whole=False), percent))
    parts = F.ceil(F.col("count") / PART_LINES).cast("int")
    targets = warm.withColumns({"part": F.pmod(F.xxhash64("id", "no"), parts).cast("int"), "band": band_of(F.col("n"), percent)})
    open_rows = warm.join(near, ["id", "no"], "left_anti").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    open_rows = open_rows.withColumn("band", F.explode(bands_for(F.col("n"), percent)))
    matches = candidates(cold, cold, ["token"], percent).union(candidates(open_rows, targets, ["token", "part", "band"], percent))
    pairs = written(paired(matches, percent).join(near, ["id", "no"], "left_anti"))
    return near.union(verified(docs, pairs, percent)).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a key of its own for each row, which orders them.

    That is the id where all ids are unique. Otherwise rows are ordered by id (null ids last), then by a hash of their
    text, then as they were read; these keys are written down before they are used.
    """
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").count().where("count > 1 or id is null")
    if ids.isEmpty():
        return docs.withColumn(_LINE_KEY, F.col(id_col))
    key = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("given"), F.xxhash64(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return written(docs.withColumn(_LINE_KEY, key))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n_lines: str = "n_lines", n_removed: str = "n_removed"
) -> DataFrame:
    """``docs`` with the lines left that no earlier line matches, and the numbers of lines and of lines removed.

    Lines are what line feeds part; one comes before another in a document of smaller id, or higher in the same
    document. A line with a word is removed if an earlier line equals it, or if the earlier first occurrence of a line
    has a Jaccard similarity of ``percent`` or more with it over distinct words. Lines without a word stay. A null text
    stays null and has no lines. Other columns are untouched; ``n_lines`` and ``n_removed`` name the columns that are
    added, in place of columns of those names. An empty table is valid.

    Every row is a document of its own. Rows that share an id come in the order of a hash of their texts, and rows with a
    null id after all others in that order; of rows alike in both the one read first keeps the lines. Texts of any length
    are valid: a line is described on its own, and only its prefix tokens are shuffled.
    """
    docs = keyed(docs, id_col, text_col)
    slim = docs.select(F.col(_LINE_KEY).alias("id"), F.col(text_col).alias("text"))
    firsts = written(first_lines(slim, percent))
    near = written(near_matches(slim, firsts, percent))
    stays = firsts.select("id", "no").join(near, ["id", "no"], "left_anti")
    kept = stays.groupBy(F.col("id").alias("__line_of")).agg(F.sort_array(F.collect_list("no")).alias("__line_kept"))
    blank = F.filter(F.sequence(F.lit(0), F.size("__line_lines") - 1), lambda i: ~F.element_at("__line_lines", i + 1).rlike("[^\\s]"))
    stay = F.sort_array(F.concat(blank, F.coalesce("__line_kept", F.array().cast("array<int>"))))
    out = docs.join(kept, F.col(_LINE_KEY) == F.col("__line_of"), "left").withColumn("__line_lines", lines_of(F.col(text_col)))
    out = out.withColumn("__line_stay", F.when(F.col(text_col).isNotNull(), stay))
    text = F.array_join(F.transform("__line_stay", lambda i: F.element_at("__line_lines", i + 1)), "\n")
    total, left = F.size("__line_lines"), F.size("__line_stay")
    number = lambda c: F.when(F.col(text_col).isNotNull(), c).otherwise(F.lit(0)).cast("long")  # noqa: E731
    plain = [c for c in docs.columns if c not in (_LINE_KEY, n_lines, n_removed)]
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in plain], number(total).alias(n_lines), number(total - left).alias(n_removed)
    )  # fmt: skip


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, no, parts[no + 1] AS line, len(parts) AS n_lines
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) a) b),
worded AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS nth FROM lines WHERE regexp_matches(line, '[^\s]')),
firsts AS (
  SELECT row_number() OVER (ORDER BY doc_id, no) AS k, doc_id, no,
         list_filter(list_distinct(string_split(regexp_replace(line, '[	
]', ' ', 'g'), ' ')), lambda x: x <> '') AS t
  FROM worded WHERE nth = 1),
uses AS (SELECT tok, count(*) AS uses FROM (SELECT unnest(t) AS tok FROM firsts) x GROUP BY 1),
ranked AS (
  SELECT k, n, tok, row_number() OVER (PARTITION BY k ORDER BY uses, tok) AS r
  FROM (SELECT k, len(t) AS n, unnest(t) AS tok FROM firsts) x JOIN uses USING (tok)),
prefix AS (SELECT k, n, tok FROM ranked WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.k AS x, b.k AS y FROM prefix a JOIN prefix b USING (tok) WHERE a.k < b.k AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
near AS (
  SELECT DISTINCT y FROM (
    SELECT y, len(list_intersect(a.t, b.t)) AS c, len(a.t) + len(b.t) AS s FROM pairs JOIN firsts a ON a.k = x JOIN firsts b ON b.k = y) q
  WHERE 100 * c >= 80 * (s - c)),
gone AS (
  SELECT doc_id, no FROM worded WHERE nth > 1 UNION ALL SELECT doc_id, no FROM firsts JOIN near ON y = k),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE g.no IS NOT NULL) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (WHERE g.no IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, no) GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

QUERIES = {"op5_lines": op5_lines}
ORACLE = {"op5_lines": SQL}
