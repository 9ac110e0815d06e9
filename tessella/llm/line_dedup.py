"""Line deduplication by a deletion-neighbourhood join. DataFrame operations only.

Lines are compared as sequences of lower-cased words. A line goes if an earlier line (by doc_id, then
by its number) is equal to it or, where both have :data:`LEAST_WORDS` words or more, is within one edit
of a word. Equal lines are one class by the 128-bit hash of their words. Each class emits the hashed
keys of all its variants with up to one word deleted, in time linear in its words by running sums of
positional word hashes. Two lines are within one edit exactly if they share a variant with the same
word deleted, or one is a variant of the other; so each line needs only the least line of its groups of
equal variants, and no pairs are made. What is found is then verified word by word.

Variants are emitted only by lines that share the first or last half of their words with another line of
fitting length. One edit leaves one of the halves whole, so this loses nothing.

Cases: null and empty texts have no lines; blank lines are neither compared nor dropped; lines of one
row are compared like those of others; rows repeated with equal id and text count once and get equal
results, rows of one id with other texts are ordered by a hash of the text; a null id comes last; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import free_name, join_skewed, materialize, running_total

#: Words of the shortest lines that are compared by edits: one of five words is a fifth.
LEAST_WORDS = 5
LAST = (1 << 63) - 1
#: Position hashes are cut to 40 bits, so sums over eight million words fit a long.
CUT = (1 << 40) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the row's key (did, th): its id, null last, and a hash of its text."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def _single_blanks(line: str) -> Column:
    """The column ``line`` with single blanks; only lines that hold other white space go through the expression."""
    other = F.contains(F.col(line), F.lit("  "))
    for blank in "\t\x0b\x0c\r":
        other |= F.contains(F.col(line), F.lit(blank))
    return F.when(other, F.regexp_replace(line, r"[\x09\x0B-\x0D ]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(F.col(line))


HALVES = ["half1", "half2", "half3", "half4"]


def _halves() -> dict[str, Column]:
    """Keys of the whole halves that a partner with as many, one fewer or one more word may share; null for short lines."""
    keys = []
    for shorter in ("size", "(size - 1)"):
        keys.append(f"xxhash64({shorter}, 1, substring_index(norm, ' ', {shorter} div 2))")
        keys.append(f"xxhash64({shorter}, 2, substring_index(norm, ' ', -({shorter} - {shorter} div 2)))")
    return {name: F.expr(f"CASE WHEN size >= {LEAST_WORDS} THEN {key} END") for name, key in zip(HALVES, keys)}


def line_table(docs: DataFrame) -> DataFrame:
    """``(did, th, line, h, size, half1 .. half4)``: every line with a word."""
    lines = _keyed(docs).filter("text <> ''").select("did", "th", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "raw"))
    lines = lines.select("did", "th", "line", F.trim(_single_blanks("raw")).alias("norm")).filter("norm <> ''")
    lines = lines.withColumn("size", (F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("int")).withColumns(_halves())
    return lines.select("did", "th", "line", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("h"), "size", *HALVES)


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(lid, words)`` of the lines ``wanted(lid, did, th, line)``."""
    by_row = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("line", "lid")).alias("wanted"))
    rows = _keyed(docs).filter("text <> ''").join(by_row.hint("merge"), ["did", "th"])
    lines = rows.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    lines = lines.select("w.lid", F.lower(F.get("lines", F.col("w.line"))).alias("raw"))
    return lines.select("lid", F.split(F.trim(_single_blanks("raw")), " ").alias("words")).dropDuplicates(["lid"])


def deletion_variants(lines: DataFrame) -> DataFrame:
    """``(v1, v2, size, pos, lid)`` of ``lines(lid, words)``: each line itself (pos 0) and with each word deleted."""
    words = lines.select("lid", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    here, shifted = F.xxhash64(F.col("p"), "word"), F.xxhash64(F.col("p") - 1, F.col("word"))
    low, high = (lambda x: x.bitwiseAND(CUT)), (lambda x: F.shiftrightunsigned(x, 24))
    words = words.select("lid", "n", "p", low(here).alias("a1"), high(here).alias("a2"), low(shifted).alias("c1"), high(shifted).alias("c2"))
    whole = Window.partitionBy("lid")
    upto = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    # running sums of both hashes; the last row of a line has the sums of all its words
    sums = words.select("lid", "n", "p", *(F.sum(x).over(upto).alias(f"{x}_upto") for x in ("a1", "a2", "c1", "c2")), *(F.sum(x).over(whole).alias(f"{x}_all") for x in ("a1", "a2", "c1", "c2")), "a1", "a2")
    deleted = F.struct((F.col("a1_upto") - F.col("a1") + F.col("c1_all") - F.col("c1_upto")).alias("v1"), (F.col("a2_upto") - F.col("a2") + F.col("c2_all") - F.col("c2_upto")).alias("v2"), (F.col("n") - 1).alias("size"), (F.col("p") + 1).alias("pos"))
    itself = F.struct(F.col("a1_all").alias("v1"), F.col("a2_all").alias("v2"), F.col("n").alias("size"), F.lit(0).alias("pos"))
    return sums.select("lid", F.explode(F.when(F.col("p") == 0, F.array(itself, deleted)).otherwise(F.array(deleted))).alias("v")).select("v.*", "lid")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one replaced, inserted or deleted word at most."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    unlike = F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x != y)
    at = F.array_position(unlike, True).cast("int")
    rest = F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(short))
    replaced = F.size(F.filter(unlike, lambda x: x)) <= 1
    return F.when(F.size(long) == F.size(short), replaced).when(F.size(long) == F.size(short) + 1, F.when(at == 0, True).otherwise(rest)).otherwise(False)


def near_earlier(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cid)`` of the classes whose first line has an earlier line within one edit."""
    halves = classes.filter(F.col("size") >= LEAST_WORDS).select("cid", F.explode(F.array(*HALVES)).alias("half"))
    shared = materialize(halves.groupBy("half").agg(F.count("*").alias("lines")).filter("lines > 1"), "lines-halves")
    wanted = join_skewed(halves, shared, "half", "lines").select("cid").distinct().join(classes.select("cid", "place"), "cid")
    # numbers in the order of place: the least number of a group is its earliest line
    ordered = running_total(wanted.select("cid", "place.*").withColumn("one", F.lit(1)), ["did", "th", "line"], "one", "lid", "lines-order").drop("one")
    ordered = materialize(ordered, "lines-numbered")
    lines = materialize(_words_of(docs, ordered), "lines-wanted")
    variants = materialize(deletion_variants(lines), "lines-variants")
    key = ["v1", "v2", "size"]
    same = materialize(variants.groupBy(*key, "pos").agg(F.min("lid").alias("least"), F.count("*").alias("n")), "lines-same")
    groups = same.groupBy(*key).agg(F.min("least").alias("any"), F.min(F.when(F.col("pos") == 0, F.col("least"))).alias("itself"), F.sum("n").alias("n")).filter("n > 1")
    groups = materialize(groups.select(F.struct(*key).alias("v"), "any", "itself", "n"), "lines-groups")
    found = materialize(join_skewed(variants.select(F.struct(*key).alias("v"), "pos", "lid"), groups, "v", "n").drop("n"), "lines-met")
    replaced = materialize(same.filter("pos > 0 and n > 1").select(F.struct(F.struct(*key).alias("v"), "pos").alias("vp"), "least", "n"), "lines-replaced")
    with_least = join_skewed(found.withColumn("vp", F.struct("v", "pos")), replaced, "vp", "n").select("lid", "least")
    partners = found.select("lid", F.when(F.col("pos") == 0, F.col("any")).otherwise(F.col("itself")).alias("least")).unionByName(with_least)
    earliest = materialize(partners.groupBy("lid").agg(F.min("least").alias("other")).filter("other < lid"), "lines-partners")
    uses = earliest.groupBy("other").agg(F.count("*").alias("uses"))
    others = materialize(uses.join(lines.select(F.col("lid").alias("other"), F.col("words").alias("other_words")), "other"), "lines-others")
    joined = join_skewed(earliest.join(lines, "lid"), others, "other", "uses")
    return joined.filter(within_one_edit(F.col("words"), F.col("other_words"))).select("lid").join(ordered.select("lid", "cid"), "lid").select("cid")


def line_decisions(docs: DataFrame) -> DataFrame:
    """``(doc_id, did, th, n_lines, dropped_lines)`` for every row of ``docs(doc_id, text)``; lines are numbered from 0."""
    lines = materialize(line_table(docs), "lines")
    place = F.struct("did", "th", "line")
    classes = lines.groupBy("h").agg(F.min(place).alias("place"), F.count("*").alias("copies"), F.max("size").alias("size"), *(F.max(x).alias(x) for x in HALVES))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "lines-classes")
    near = materialize(near_earlier(docs, classes), "lines-near")
    settled = classes.select("cid", "h", "place", "copies").join(near.withColumn("near", F.lit(True)), "cid", "left")
    settled = materialize(settled.filter("near or copies > 1"), "lines-settled")  # a line met once with no partner stays
    marked = join_skewed(lines.select("did", "th", "line", "h"), settled, "h", "copies")
    dropped = marked.filter(F.coalesce("near", F.lit(False)) | (place != F.col("place")))
    by_row = dropped.groupBy("did", "th").agg(F.sort_array(F.collect_set("line")).alias("dropped_lines"))
    rows = _keyed(docs).select("doc_id", "did", "th", F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    return rows.join(by_row, ["did", "th"], "left").withColumn("dropped_lines", F.coalesce("dropped_lines", F.array().cast("array<int>"))).select("doc_id", "did", "th", "n_lines", "dropped_lines")


def drop_repeated_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all columns, without the lines that repeat an earlier one."""
    did, th, gone = (free_name(docs, n) for n in ("did", "th", "gone"))
    by_row = line_decisions(docs).filter(F.size("dropped_lines") > 0).dropDuplicates(["did", "th"]).select(F.col("did").alias(did), F.col("th").alias(th), F.col("dropped_lines").alias(gone))
    rows = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), th: F.xxhash64(F.coalesce(text, F.lit("")))})
    joined = rows.join(by_row, [did, th], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text <> ''
), n AS (
  SELECT doc_id, line, trim(regexp_replace(lower(raw), '[\x09\x0B-\x0D ]+', ' ', 'g')) AS norm FROM l
), w AS (
  SELECT doc_id, line, norm, min(row(doc_id, line)) OVER (PARTITION BY norm) AS place FROM n WHERE norm <> ''
), c AS (
  SELECT norm, any_value(place) AS place, string_split(norm, ' ') AS words, len(string_split(norm, ' ')) AS size
  FROM w GROUP BY norm
), k AS (
  SELECT norm, place, words, size, unnest([size, size - 1]) AS s FROM c WHERE size >= 5
), h AS (
  SELECT norm, place, words, size, s, unnest([words[1:s // 2], words[size - (s - s // 2) + 1:]]) AS half, unnest([1, 2]) AS side FROM k
), p AS (
  SELECT DISTINCT a.norm, a.words AS x, b.words AS y
  FROM h a JOIN h b ON a.s = b.s AND a.side = b.side AND a.half = b.half AND b.place < a.place
), near AS (
  SELECT DISTINCT norm FROM p
  WHERE CASE WHEN len(x) = len(y) THEN len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) <= 1
        WHEN len(x) = len(y) + 1 THEN list_contains(list_transform(range(1, len(x) + 1), lambda i: list_concat(x[1:i - 1], x[i + 1:])), y)
        WHEN len(y) = len(x) + 1 THEN list_contains(list_transform(range(1, len(y) + 1), lambda i: list_concat(y[1:i - 1], y[i + 1:])), x)
        ELSE false END
), gone AS (
  SELECT doc_id, line FROM w WHERE place <> row(doc_id, line) OR norm IN (SELECT norm FROM near)
)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(g.n, 0) AS n_dropped, coalesce(g.lines, '') AS dropped_lines
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM gone GROUP BY doc_id
) g ON d.doc_id = g.doc_id
"""
