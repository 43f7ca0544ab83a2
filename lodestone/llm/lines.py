"""Line deduplication by a segment-partition edit join, in DataFrame and SQL functions only.

Lines within THRESHOLD edits form classes; of each class the first line in the corpus stays. By the
pigeonhole principle, of a line cut into threshold + 1 segments at least one occurs unharmed in any
line within the threshold, near its own place. Segments are indexed under (length, number, content);
each line probes the indexes of its own and of slightly smaller lengths with the few substrings that
can match. Semi-joins first tell which lines share a key at all, however many do. Only for these are letters
counted; a join condition on the counts, and on enough pieces of the line being unharmed, discards most chance hits
before they become rows, and the rest is verified with a banded bit-parallel edit distance.
Lines of a dense group are linked through the most frequent one, so that a group of n near copies makes some n pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import components, discard, free_name, materialise, table

#: Edits; code points from which a line may be near another (shorter ones only equal one).
THRESHOLD, NEAR_FROM = 2, 5
#: Characters that the join's filter counts, modulo 16 each, in two numbers; pieces that its last filter looks for.
LETTERS, PIECES = ("etnraisohdlucmf", "pgwybvkxjqz ,.-"), 12


def segments(length: str, number: str, k: int) -> tuple[str, str]:
    """SQL for a segment's start (from 1) and length; numbers count from 0. The last segments take the remainder."""
    rest = f"pmod({length}, {k + 1})"
    base = f"({length} DIV {k + 1})"
    early = f"({k + 1} - {number})"  # segments from this one on
    start = f"cast(1 + {number} * {base} + greatest(0, {rest} - {early}) as int)"
    return start, f"cast({base} + IF({rest} >= {early}, 1, 0) as int)"


def probes(k: int) -> list[tuple[int, int, int]]:
    """(shorter, number, shift) of the substrings that can match a segment of a line that is shorter by 0 to k.

    Of the shifts of segment i, those are left out that more edits before it, or after it, would need
    than another segment's match leaves over. In lines of 2k + 1 code points or more all lie inside.
    """
    return [(shorter, i, shift) for shorter in range(k + 1) for i in range(k + 1) for shift in range(max(-i, shorter - (k - i)), min(i, shorter + (k - i)) + 1)]


def keyed(lines: DataFrame, combos: list[tuple[int, int, int]], k: int) -> DataFrame:
    """(key, row) for each line and combination: a hash of a length, a segment's number and a substring."""
    listed = ", ".join(f"named_struct('less', {a}, 'i', {b}, 'shift', {c})" for a, b, c in combos)
    start, size = segments("(n - c.less)", "c.i", k)
    return lines.select("row", "line", F.length("line").alias("n"), F.explode(F.expr(f"array({listed})")).alias("c")).selectExpr(f"xxhash64(n - c.less, c.i, substring(line, {start} + c.shift, {size})) AS key", "row")


def letter_counts(letters: str) -> str:
    """SQL for the counts of letters in a line modulo 16, four bits each."""
    return " | ".join(f"shiftleft(cast((length(line) - length(replace(line, '{c}', ''))) & 15 as bigint), {4 * i})" for i, c in enumerate(letters))


def apart(a: str, b: str) -> str:
    """SQL for the sum of the differences, around a circle of 16, of two packed counts: at most two for each edit."""
    terms = []
    for i in range(len(LETTERS[0])):
        d = f"(((shiftright({a}, {4 * i}) & 15) - (shiftright({b}, {4 * i}) & 15)) & 15)"
        terms.append(f"least({d}, 16 - {d})")
    return " + ".join(terms)


def unharmed(a: str, b: str, k: int) -> str:
    """SQL for whether b holds all but k of the PIECES of a, each within k of its place: so it is if they are within k edits."""
    at = lambda i: f"({i} * length({a}) DIV {PIECES})"
    found = []
    for i in range(PIECES):
        size = f"({at(i + 1)} - {at(i)})"
        low = f"greatest(0, {at(i)} - {k})"
        found.append(f"IF(instr(substring({b}, {low} + 1, {at(i)} + {size} + {k} - {low}), substring({a}, {at(i)} + 1, {size})) > 0, 1, 0)")
    return f"({' + '.join(found)}) >= {PIECES - k}"


def edit_distance(a: str, b: str, k: int) -> str:
    """SQL for the edit distance of two strings whose lengths differ by k at most; right up to k, and above k beyond.

    One word holds the vertical differences of the 2k + 1 cells around the diagonal; each character
    of b moves it a row down. The distance is followed along the band's lower edge until that
    passes the end of a, and then along a's last row. Once it can't come back to k it stays as it is.
    """
    word, mask = 2 * k + 1, (1 << (2 * k + 1)) - 1
    start = ((1 << (k + 1)) - 1) << k
    hits = " | ".join(f"IF(get(t.a, j + {d - k - 1}) = get(t.b, j - 1), {1 << d}, 0)" for d in range(word))
    step = f"""transform(array({hits}), x ->
      transform(array((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn), d0 ->
        transform(array(named_struct('d', d0 & {mask}, 'hp', (s.vn | ~(d0 | s.vp)) & {mask}, 'hn', d0 & s.vp & {mask})), h ->
          named_struct(
            'vp', (h.hn | ~(shiftright(h.d, 1) | h.hp)) & {mask},
            'vn', shiftright(h.d, 1) & h.hp,
            'far', s.far + IF(j + {k} <= size(t.a), 1 - (shiftright(h.d, {2 * k}) & 1),
              (shiftright(h.hp, size(t.a) - j + {k}) & 1) - (shiftright(h.hn, size(t.a) - j + {k}) & 1)))
        )[0])[0])[0]"""
    chars = lambda x: f"IF(length({x}) = 0, cast(array() as array<string>), split({x}, '', length({x})))"
    # the word's initial bits: +1 for each row from 1 on
    return f"""transform(array(named_struct('a', {chars(a)}, 'b', {chars(b)})), t ->
      aggregate(IF(size(t.b) = 0, cast(array() as array<int>), sequence(1, size(t.b))),
        named_struct('vp', {start}, 'vn', 0, 'far', least({k}, size(t.a))), (s, j) -> IF(s.far > {2 * k} + size(t.b) - size(t.a), s, {step}), s -> s.far))[0]"""


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row per line that isn't blank: doc_id, text_hash, line_no (from 0), h1 and h2 (128 bits of a hash of the line), line."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return rows.where(F.length(F.trim("line")) > 0).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def edit_links(lines: DataFrame, k: int = THRESHOLD, near_from: int = NEAR_FROM, spanning: bool = False) -> DataFrame:
    """Pairs (a, b) of rows of lines (row long, line string, both distinct) of near_from code points at least that are within k edits.

    With spanning, only as many of them as connect what all of them connect, or somewhat more: lines are first compared with
    the most frequent line (by column copies) under each of their keys, and then only with lines that aren't connected to them yet.
    """
    if near_from < 2 * k + 1:
        raise ValueError("near_from must be 2k + 1 at least")
    copies = "copies" if "copies" in lines.columns else "1L AS copies"
    long = lines.where(F.length("line") >= near_from).selectExpr("row", "line", copies)
    own = keyed(long, [(0, i, 0) for i in range(k + 1)], k).withColumnRenamed("row", "own")
    asked = materialise(keyed(long, probes(k), k).alias("x").join(own.alias("y"), F.expr("x.key = y.key AND x.row <> y.own"), "left_semi"), "asked")
    own = materialise(own.join(asked.select("key").distinct(), "key", "left_semi"), "own")
    ids = asked.select("row").unionAll(own.select("own")).distinct()
    # merged at every size: a broadcast that small inputs would get says nothing about large ones
    wanted = materialise(long.hint("merge").join(ids, "row", "left_semi").selectExpr("row", "line", "copies", *[f"{letter_counts(c)} AS n{i}" for i, c in enumerate(LETTERS)]), "wanted")
    x = own.join(wanted.selectExpr("row AS own", "n0", "n1", "copies", "line AS x"), "own")
    y = asked.join(wanted.selectExpr("row", "n0 AS m0", "n1 AS m1", "line AS y"), "row")
    alike = F.expr(f"own <> row AND {apart('n0', 'm0')} + {apart('n1', 'm1')} <= {2 * k} AND {unharmed('x', 'y', k)}")
    used = []

    def verified(meet: DataFrame) -> DataFrame:
        pairs = materialise(meet.select(F.least("own", "row").alias("a"), F.greatest("own", "row").alias("b")).distinct(), "pairs")
        shorter, longer = F.expr("IF(length(x) <= length(y), x, y)").alias("x"), F.expr("IF(length(x) <= length(y), y, x)").alias("y")
        both = pairs.join(wanted.selectExpr("row AS a", "line AS x"), "a").join(wanted.selectExpr("row AS b", "line AS y"), "b").select("a", "b", shorter, longer)
        used.append(pairs)
        return materialise(both.where(F.expr(f"{edit_distance('x', 'y', k)} <= {k}")).select("a", "b"), "links")

    if spanning:
        x, y = materialise(x, "own"), materialise(y, "asked")
        hubs = x.groupBy("key").agg(F.max(F.struct("copies", -F.col("own"), "n0", "n1", "x")).alias("hub")).selectExpr("key", "-hub.col2 AS own", "hub.n0", "hub.n1", "hub.x")
        first = verified(y.join(materialise(hubs, "hubs"), "key").where(alike))
        parts = materialise(components(first), "parts")
        x = x.join(parts.selectExpr("node AS own", "root AS part"), "own", "left").withColumn("part", F.coalesce("part", "own"))
        y = y.join(parts.selectExpr("node AS row", "root AS asked_part"), "row", "left").withColumn("asked_part", F.coalesce("asked_part", "row"))
        links = first.unionAll(verified(x.join(y, (x.key == y.key) & (x.part != y.asked_part) & alike)))
        used.append(parts)
    else:
        links = verified(x.join(y, (x.key == y.key) & alike))
    discard(asked, own, wanted, *used)
    return links


def line_classes(docs: DataFrame, doc_id: str, text: str, k: int = THRESHOLD, near_from: int = NEAR_FROM) -> DataFrame:
    """Each line of docs that isn't blank with the first line of its class.

    Classes: lines connected by links of at most k edits between lines of near_from code points or
    more; shorter lines are in a class with equal ones. First: by id (null last), then by a hash
    of the text (for repeated ids), then by number. Null and empty texts have no lines; repeated rows
    count as one. Lines are told apart by a 128-bit hash; extra columns are left out.
    Returns doc_id, text_hash, line_no, first_doc_id, first_text_hash, first_line_no, kept.
    """
    seen = occurrences(docs, doc_id, text)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "line_no")
    lines = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("line").alias("line"), F.count("*").alias("copies"))
    lines = materialise(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    links = edit_links(lines, k, near_from, spanning=True)
    firsts = materialise(lines.select("h1", "h2", "first", "row"), "firsts")
    discard(lines)
    roots = materialise(components(links), "roots")
    joined = roots.join(firsts, roots.node == firsts.row)
    low = materialise(joined.groupBy("root").agg(F.min("first").alias("low")), "low")
    near = materialise(roots.join(low, "root").select(F.col("node").alias("row"), "low"), "near")
    info = materialise(firsts.join(near, "row", "left").select("h1", "h2", F.coalesce("low", "first").alias("first")), "info")
    discard(roots, firsts, low, near)
    out = seen.drop("line").join(info, ["h1", "h2"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select("doc_id", "text_hash", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_text_hash"), F.col("first.line_no").alias("first_line_no"), same.alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str, text: str, k: int = THRESHOLD, near_from: int = NEAR_FROM) -> DataFrame:
    """docs with only the first line of each class in its texts; blank lines stay.

    A row that had lines and keeps none goes; rows without lines stay as they are. Columns stay; n_chars,
    if there is one, follows the text.
    """
    spare = line_classes(docs, doc_id, text, k, near_from).where("NOT kept").distinct()
    key, mark, drop, left, gone = (free_name(docs, f"dedup_{n}") for n in ("id", "hash", "drop", "left", "all"))
    spare = materialise(spare.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).agg(F.collect_list("line_no").alias(drop)), "spare")
    rows = docs.hint("merge").join(spare, F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(mark)), "left")
    rows = rows.withColumn(gone, F.split(F.col(text), "\n"))
    index = F.array_except(F.sequence(F.lit(0), F.size(gone) - 1), F.col(drop))
    rows = rows.withColumn(left, F.when(F.col(drop).isNotNull(), F.transform(index, lambda i: F.get(F.col(gone), i))))
    rows = rows.where(F.col(left).isNull() | F.exists(left, lambda x: F.length(F.trim(x)) > 0))
    new = F.coalesce(F.array_join(left, "\n"), F.col(text))
    return rows.select(*[new.alias(c) if c == text else F.when(F.col(left).isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_classes(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", "line_no", F.col("first_doc_id").alias("class_doc_id"), F.col("first_line_no").alias("class_line_no"), "kept")


#: DuckDB's distance counts bytes: these letters become one byte each.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_NARROW = " || ".join(f"chr({i})" for i in [*range(1, 9), 11, 12, *range(14, 32), 127][: len(_WIDE)])

SQL = f"""
WITH RECURSIVE o AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no
  FROM documents WHERE text IS NOT NULL
), s AS (SELECT * FROM o WHERE length(trim(line, ' ')) > 0
), d AS (SELECT line, length(line) AS n, row_number() OVER (ORDER BY line) AS id, {', '.join(f"length(line) - length(replace(line, '{c}', '')) AS {c}" for c in 'etnraiso')} FROM (SELECT DISTINCT line FROM s)
), p AS (
  SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON y.n BETWEEN x.n AND x.n + {THRESHOLD} AND x.id <> y.id AND x.n >= {NEAR_FROM}
  WHERE {' AND '.join(f"abs(x.{c} - y.{c}) <= {THRESHOLD}" for c in 'etnraiso')} AND levenshtein(translate(x.line, '{_WIDE}', {_NARROW}), translate(y.line, '{_WIDE}', {_NARROW})) <= {THRESHOLD}
), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (SELECT id AS a, id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS id, min(b) AS class FROM r GROUP BY 1
), m AS (SELECT s.doc_id, s.line_no, c.class FROM s JOIN d USING (line) JOIN c USING (id)
), f AS (SELECT class, min(struct_pack(d := doc_id, n := line_no)) AS f FROM m GROUP BY 1)
SELECT m.doc_id, m.line_no, f.f.d AS class_doc_id, f.f.n AS class_line_no, m.doc_id = f.f.d AND m.line_no = f.f.n AS kept
FROM m JOIN f USING (class)
"""
