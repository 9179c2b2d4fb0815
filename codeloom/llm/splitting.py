"""Splitting of oversized texts at natural boundaries, in SQL expressions alone.

A regular expression whose alternatives are ordered by the strength of the boundary they end at consumes up to the limit
with bounded quantifiers; the last alternative cuts between any two characters. It runs twice: over lines, then
over characters of those blocks that are still too long. Lookback over the text before each piece supplies the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread, table

MAX_LINES = 80
MAX_CHARS = 6000
OVERLAP_LINES = 5
#: Room for overlap is reserved in steps of so many characters, so that few patterns are compiled.
_STEP = 500

_LINE = r"(?:[^\n]*\n)"
_OPENING = (
    r"(?:@|#|//|/\*|(?:async[ ]+)?def[ ]|class[ ]|export[ ]|(?:async[ ]+)?function\b|const[ ]|let[ ]|var[ ]|interface[ ]|type[ ]|enum[ ]|import[ ]|if[ ]__name__)"
)


def line_count(content: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + F.when(
        content.endswith("\n") | (content == ""), 0
    ).otherwise(1)


def _by_lines(most: int) -> str:
    half = max(1, most // 2)
    return "|".join(
        [
            rf"{_LINE}{{0,{most - 1}}}[^\n]+\z",  # all that is left
            rf"{_LINE}{{1,{most}}}\z",
            rf"{_LINE}{{{half},{most}}}(?<=\n[ \t\r]{{0,80}}\n)(?={_OPENING})",  # an empty line, then a new definition at the margin
            rf"{_LINE}{{{half},{most}}}(?={_OPENING})",
            rf"{_LINE}{{{half},{most}}}(?<=\n[ \t\r]{{0,80}}\n)",  # an empty line
            rf"{_LINE}{{{half},{most}}}(?=[ \t]{{1,80}}{_OPENING})",  # a definition within another
            rf"{_LINE}{{{half},{most}}}(?<=\n[ \t]{{0,80}}[}}\])]{{1,4}}[;,]?\r?\n)",  # a closed block
            rf"{_LINE}{{1,{most}}}",
        ]
    )


def _by_chars(most: Column) -> Column:
    upto = F.concat(F.greatest(F.lit(1), F.floor(most / 2)).cast("string"), F.lit(","), most.cast("string"))
    ends = [
        r"(?<=\n[ \t\r]{0,80}\n)",
        r"(?<=\n[ \t]{0,80}[}\])]{1,4}[;,]?\r?\n)",
        r"(?<=\n)",
        r"(?<=[;{}])",
        r"(?<=[,\s])",
    ]
    return F.concat(
        F.lit("(?s).{1,"), most.cast("string"), F.lit(r"}\z"),
        *[F.concat(F.lit("|.{"), upto, F.lit("}" + e)) for e in ends],
        F.lit("|.{1,"), most.cast("string"), F.lit("}"),
    )


def split_oversized(
    items: DataFrame, *, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap_lines: int = OVERLAP_LINES
) -> DataFrame:
    """Pieces of the items whose ``content`` exceeds a limit: id, piece_no, line_start, line_end, content, core_start.

    Pieces are numbered from 1 and hold the item's text in order; each begins with up to ``overlap_lines`` whole lines of
    the text before it, fewer where they would break a limit and none where a line itself had to be cut.
    ``core_start`` is the offset in the piece at which its own text begins, so that the cores joined are the item.
    ``line_start`` and ``line_end`` count in the file if the item's ``line_start`` is known, else from null.
    Items within both limits, null and empty ones give no rows; repeated rows give pieces each.
    """
    if not 0 <= overlap_lines < max_lines:
        raise ValueError("overlap_lines must be below max_lines")
    content = F.col("content")
    over = spread(items.where((F.length(content) > max_chars) | (line_count(content) > max_lines)).select("id", content, F.col("line_start").alias("_from")))
    widths = F.transform(F.split(content, "\n", -1), lambda line: F.length(line) + 1)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_widths") - (overlap_lines - 1))),
        lambda i: F.aggregate(F.slice("_widths", i, max(overlap_lines, 1)), F.lit(0), lambda a, x: a + x),
    )
    room = F.least(F.ceil(F.array_max(runs) / _STEP) * _STEP, F.lit(max_chars // 2)) if overlap_lines else F.lit(0)
    most = F.greatest(F.lit(1), F.lit(max_chars) - room).cast("int")
    blocks = F.regexp_extract_all(content, F.lit(_by_lines(max_lines - overlap_lines)), F.lit(0))
    pieces = F.flatten(
        F.transform(blocks, lambda b: F.when(F.length(b) <= F.col("_most"), F.array(b)).otherwise(F.regexp_extract_all(b, F.col("_pattern"), F.lit(0))))
    )
    begin = F.col("_p._ends") - F.length("_p._pieces")
    sums = lambda numbers: F.aggregate(numbers, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))  # noqa: E731  # from 0, one more than numbers
    breaks = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    cut = (
        over.withColumn("_widths", widths)  # a column of its own, else the lines are cut anew for each run of them
        .withColumn("_most", most)
        .withColumn("_pattern", _by_chars(F.col("_most")))
        .withColumn("_pieces", pieces)
        .withColumn("_ends", F.slice(sums(F.transform("_pieces", F.length)), 2, F.size("_pieces")))
        .withColumn("_breaks", F.slice(sums(F.transform("_pieces", breaks)), 1, F.size("_pieces")))
        .select("id", "_from", "content", F.posexplode(F.arrays_zip("_pieces", "_ends", "_breaks")).alias("_no", "_p"))
        .select("id", "_from", (F.col("_no") + 1).alias("piece_no"), F.col("_p._pieces").alias("_core"), begin.alias("_begin"), F.substring("content", F.greatest(F.lit(1), begin - max_chars), F.least(begin, F.lit(max_chars + 1))).alias("_before"), F.col("_p._breaks").alias("_breaks"))
    )
    spare_lines = F.lit(max_lines) - line_count(F.col("_core"))
    # Whole lines right before the piece, the most first; where the text before ends within a line there are none.
    tail, ended = F.col("_tail"), F.element_at("_tail", -1) == ""
    backs = F.transform(
        F.sequence(F.least(F.lit(overlap_lines), F.size(tail) - 1), F.lit(0), F.lit(-1)),
        lambda k: F.when(ended & (k > 0), F.concat(F.array_join(F.slice(tail, F.size(tail) - k, k), "\n"), F.lit("\n"))).otherwise(F.lit("")),
    )
    fitting = F.filter(backs, lambda b: (b != "") & (F.length(b) + F.length("_core") <= max_chars) & (line_count(b) <= spare_lines))
    back = F.coalesce(F.get(fitting, F.lit(0)), F.lit(""))
    first = F.col("_from") + F.col("_breaks") - line_count(F.col("_back"))
    return (
        cut.withColumn("_tail", F.split("_before", "\n", -1))
        .withColumn("_back", back)
        .withColumn("content", F.concat("_back", "_core"))
        .withColumn("line_start", first.cast("int"))
        .select(
            "id",
            "piece_no",
            "line_start",
            (F.col("line_start") + line_count(F.col("content")) - 1).cast("int").alias("line_end"),
            "content",
            F.length("_back").alias("core_start"),
        )
    )


def p6_found(spark, sf_dir):
    return split_oversized(table(spark, sf_dir, "code_chunks")).where(F.col("piece_no") == 1).select("id")


def p6_pieces(spark, sf_dir):
    return split_oversized(table(spark, sf_dir, "code_chunks"))


def p6_whole(spark, sf_dir):
    """Of every oversized chunk: whether its pieces joined without their overlap are its content, all keep the limits and are numbered through."""
    chunks = table(spark, sf_dir, "code_chunks")
    core = F.struct("piece_no", F.expr("substring(content, core_start + 1)").alias("core"))
    pieces = split_oversized(chunks).groupBy("id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(core)), lambda x: x["core"]), ""), 256).alias("_joined"),
        (F.max(line_count(F.col("content"))) <= MAX_LINES).alias("lines_kept"),
        (F.max(F.length("content")) <= MAX_CHARS).alias("chars_kept"),
        (F.max("piece_no") == F.count(F.lit(1))).alias("numbered"),
    )
    return pieces.join(chunks.select("id", F.sha2("content", 256).alias("_whole")), "id").select("id", (F.col("_joined") == F.col("_whole")).alias("whole"), "lines_kept", "chars_kept", "numbered")


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_whole": p6_whole}

_OVER = """
FROM code_chunks
WHERE length(content) > 6000
   OR length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR right(content, 1) = chr(10) THEN 0 ELSE 1 END > 80
"""
ORACLE = {"p6_found": "SELECT id" + _OVER, "p6_whole": "SELECT id, true AS whole, true AS lines_kept, true AS chars_kept, true AS numbered" + _OVER}
