"""Generated, minified, third-party and data files among source files, from layout statistics of their chunks.

Statistics are sums over the chunks of a file, so that a file is never gathered anywhere. Thresholds are per language, between what
hand-written files of the language have and what minified ones and data have. Besides layout, four kinds of evidence count, since
such files are laid out like any other: a notice in the leading comment that the code is generated, a banner with a package's version and
licence, the same text in several repositories, and a folder kept for the code of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import broadcast_if_small, cut, plain_path, spread, table

#: Thresholds; a language without its own entry has those under "".
_COMMON = {
    "long_line": 240, "long_share": 0.5, "long_space": 0.10, "long_marks": 0.18, "data_chars": 800, "data_space": 0.03, "numeric_share": 0.6, "numeric_chars": 600,
    "encoded_share": 0.5, "encoded_chars": 400, "wrap_line": 70, "wrap_space": 0.07, "wrap_letters_from": 0.4, "wrap_letters_to": 0.85, "wrap_chars": 400, "wrap_marks": 0.18,
}
THRESHOLDS = {
    "": _COMMON,
    "js": _COMMON,
    "ts": _COMMON | {"wrap_line": 90},
    "jsx": _COMMON | {"long_marks": 0.2, "wrap_line": 60, "wrap_marks": 0.2},
    "tsx": _COMMON | {"long_marks": 0.2, "wrap_line": 90, "wrap_marks": 0.2},
    "py": _COMMON | {"long_marks": 0.16, "numeric_share": 0.5, "wrap_line": 140, "wrap_space": 0.05, "wrap_marks": 0.16},
}
#: Texts shorter than this say nothing about copying.
COPY_CHARS = 200
COPY_SHARE = 0.6
#: Parts of the rows that carry one copied text.
_SALTS = 8

# Wording of notices, banners and places of third-party code.
_MARK = r"(?m)^[ \t]*(?:#+|//+!?|/\*+!?|\*|<!--|\"\"\"|''')[ \t]*"
_NOTICE = _MARK + (
    r"(?:(?i:(?:this |the )?(?:code|file|module|source|class|class(?:es)?|client|stub|bindings?|parser|document)?[ \t]*(?:is |was |has been |were )?(?:auto[- ]?|automatically |machine[- ]|programmatically )?generated"
    r"(?:[ \t]+(?:code|file|by|from|with|using|automatically|on|at|via|--?|—|!|\.|;|,|do not)|[ \t]*(?:\.|!|;|,|-|—|:|\*/|$)))"
    r"|(?i:auto-?generated\b)|(?i:<auto-?generated)|@generated\b|(?i:do not (?:edit|modify|change|touch)(?: (?:by hand|manually|this file|directly|this|it))?[ \t]*(?:[.!:;,*-]|$))"
    r"|(?i:produced by [\w.-]+ from )|(?i:compiled (?:by|from|with) \w+)|(?i:[^\n]{0,60}\b(?:changes (?:will be lost|made here)|manual (?:edits|changes) will be|DO NOT EDIT\b)))"
)
_CODE = r"(?m)^[ \t]*(?!#|//|/\*|\*|<!--|\r?$)\S"
_BANNER = _MARK + (
    r"(?:@license\b[^\n]*\d|(?i:@preserve\b)|[\w.@/-]+(?:\.js|\.py)?[ \t]+v?\d+\.\d+(?:\.\d+)?[\w.-]*[ \t]*(?:$|\r|[|(,—-]|(?i:licen[cs]ed|released|copyright|upstream|by))|(?i:[^\n]{0,60}\bupstream (?:copy|source)|[^\n]{0,40}\bvendored (?:copy|from)))"
)
_VENDORED = (
    r"(?i)(?:^|/)(?:node_modules|bower_components|site-packages|jspm_packages)/|(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|3rdparty|extern(?:al)?s?|contrib/external)/"
    r"|(?:^|/)[a-z][\w]*-\d+\.\d+(?:\.\d+)?(?:[._-][\w]+)*\.(?:js|py|ts|jsx|tsx)$"
)
_MADE_NAME = r"(?i)(?:_pb2(?:_grpc)?\.py|_pb\.[jt]s|\.pb\.[jt]s|\.gen\.[jt]sx?|[._]generated\.\w+|\.g\.[jt]s)$|(?:^|/)(?:__generated__|generated)/"
_MAP_COMMENT = r"(?m)^//[#@] sourceMappingURL="
_NUMBER = r"(?<![\w.$])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w$])[,\s\[\]]*"
_ENCODED = r"[A-Za-z0-9+/_-]{60,}={0,2}|(?:\\x[0-9a-fA-F]{2}){20,}|(?:\\u[0-9a-fA-F]{4}){16,}|(?:0x[0-9a-fA-F]{2},\s*){16,}"

#: Keys and certificates in armour are no data saved as code.
_ARMOUR = r"-----BEGIN [A-Z0-9 ]+-----[^-]*-----END [A-Z0-9 ]+-----"


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _by_language(name: str) -> Column:
    chosen = F.lit(THRESHOLDS[""][name])
    for language, values in THRESHOLDS.items():
        if language and values[name] != THRESHOLDS[""][name]:
            chosen = F.when(F.col("language") == language, F.lit(values[name])).otherwise(chosen)
    return chosen


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Layout statistics of each chunk, all of them sums or flags. Costly patterns run only over chunks that can match."""
    text = F.coalesce(F.col("content"), F.lit(""))
    chars = F.length(text)
    long_text = F.array_join(F.filter(F.split(text, "\n", -1), lambda line: F.length(line) >= F.col("_limit")), "\n")
    digits = F.regexp_count(text, F.lit("[0-9]"))
    space = _without(text, r"[ \t\r\n]+")
    bare = F.when(text.contains("-----BEGIN "), F.regexp_replace(text, _ARMOUR, "")).otherwise(text)
    notice, banner, code = (F.regexp_instr(text, F.lit(p)) for p in (_NOTICE, _BANNER, _CODE))
    leads = lambda found: F.when(found > 0, (F.col("_code") == 0) | (found <= F.col("_code"))).otherwise(False)
    return (
        spread(chunks.select("index_run_id", "repo_id", plain_path(F.col("file_path")).alias("file_path"), "language", "chunk_type", text.alias("content")))
        .withColumn("_limit", _by_language("long_line"))
        .withColumn("_lengths", F.transform(F.split(text, "\n", -1), lambda line: F.length(line)))
        .withColumns({"_longest": F.array_max("_lengths"), "_lines": F.size("_lengths"), "_space": space, "_notice": notice, "_banner": banner})
        .withColumn("_code", F.when((F.col("_notice") > 0) | (F.col("_banner") > 0), code).otherwise(0))
        .withColumn("_long", F.when(F.col("_longest") >= F.col("_limit"), long_text).otherwise(F.lit("")))
        .select(
            "index_run_id", "repo_id", "file_path", "language",
            F.xxhash64("content").alias("fingerprint"),
            chars.alias("chars"),
            F.col("_longest").alias("longest"),
            F.length("_long").alias("long_chars"),
            F.col("_lines").alias("lines"),
            F.col("_space").alias("space"),
            _without(text, r"[A-Za-z0-9]+").alias("letters"),
            _without(text, r"[;{}()\[\]=?:!&|<>.]+").alias("marks"),
            F.when(F.col("_long") != "", _without(F.col("_long"), r"\s")).otherwise(0).alias("long_space"),
            F.when(F.col("_long") != "", _without(F.col("_long"), r"[;{}()\[\]=?:!&|<>.]")).otherwise(0).alias("long_marks"),
            F.when(digits > (chars - F.col("_space")) * 0.15, _without(text, _NUMBER)).otherwise(0).alias("numeric_chars"),
            F.when(F.col("_longest") >= 60, _without(bare, _ENCODED)).otherwise(0).alias("encoded_chars"),
            leads(F.col("_notice")).alias("notice"),
            leads(F.col("_banner")).alias("banner"),
            text.rlike(_MAP_COMMENT).alias("mapped"),
            F.col("chunk_type").isin("function", "method").alias("functions"),
        )
    )


def copied_texts(statistics: DataFrame) -> DataFrame:
    """Fingerprints of texts that occur in more than one repository: two-step aggregation, no group is gathered."""
    pairs = statistics.where(F.col("chars") >= COPY_CHARS).groupBy("fingerprint", "chars").agg(F.min("repo_id").alias("_a"), F.max("repo_id").alias("_b"))
    return pairs.where(F.col("_a") != F.col("_b")).select("fingerprint", "chars", F.lit(True).alias("copied"))


def file_kinds(chunks: DataFrame) -> DataFrame:
    """One row per (index_run_id, plain file_path) with ``kind``: generated, minified, data, third_party, or null for hand-written.

    A file is the set of its chunks whichever way its path is spelt; repeated chunks count as they come, which leaves
    shares as they are. Null and empty contents add nothing. A null path is a file of its own.
    """
    statistics = cut(chunk_statistics(chunks))  # texts are read once; a row of numbers for each chunk is left
    # Texts too short to tell anything join with nothing, each under a key of its own; a text of very many copies is spread over salts.
    told = F.col("chars") >= COPY_CHARS
    keyed = statistics.withColumns({
        "_print": F.when(told, F.col("fingerprint")).otherwise(F.xxhash64("index_run_id", "file_path", "fingerprint")),
        "_chars": F.when(told, F.col("chars")).otherwise(F.lit(-1)),
        "_salt": F.pmod(F.xxhash64("index_run_id", "file_path"), F.lit(_SALTS)).cast("int"),
    })
    copies = copied_texts(statistics).select(F.col("fingerprint").alias("_print"), F.col("chars").alias("_chars"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"), "copied")
    joined = keyed.join(broadcast_if_small(copies, 500_000), ["_print", "_chars", "_salt"], "left")
    files = joined.groupBy("index_run_id", "file_path").agg(
        F.min("language").alias("language"),
        *[F.sum(c).alias(c) for c in ("chars", "lines", "space", "letters", "marks", "long_chars", "long_space", "long_marks", "numeric_chars", "encoded_chars")],
        F.sum(F.when(F.col("copied"), F.col("chars")).otherwise(0)).alias("copied_chars"),
        F.max("longest").alias("longest"),
        *[F.max(c).alias(c) for c in ("notice", "banner", "mapped", "functions")],
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    long = share("long_chars", "chars") >= _by_language("long_share")
    letters = share("letters", "chars")
    wrapped = (
        (share("chars", "lines") >= _by_language("wrap_line")) & (F.col("chars") >= _by_language("wrap_chars")) & (share("space", "chars") <= _by_language("wrap_space"))
        & (letters >= _by_language("wrap_letters_from")) & (letters <= _by_language("wrap_letters_to")) & (share("marks", "chars") >= _by_language("wrap_marks"))
    )
    minified = F.col("mapped") | wrapped | (long & (share("long_space", "long_chars") <= _by_language("long_space")) & (share("long_marks", "long_chars") >= _by_language("long_marks")))
    data = (
        (long & (F.col("long_chars") >= _by_language("data_chars")) & (share("long_space", "long_chars") <= _by_language("data_space")))
        | ((share("numeric_chars", "chars") >= _by_language("numeric_share")) & (F.col("chars") >= _by_language("numeric_chars")))
        | ((share("encoded_chars", "chars") >= _by_language("encoded_share")) & (F.col("encoded_chars") >= _by_language("encoded_chars")))
    )
    third = F.col("banner") | (share("copied_chars", "chars") >= COPY_SHARE) | F.coalesce(F.col("file_path").rlike(_VENDORED), F.lit(False))
    made = F.col("notice") | (F.coalesce(F.col("file_path").rlike(_MADE_NAME), F.lit(False)) & ~F.col("functions"))
    return files.withColumn(
        "kind", F.when(made, "generated").when(third, "third_party").when(data, "data").when(minified, "minified")
    )


def hand_written(chunks: DataFrame) -> DataFrame:
    """The chunks of files that are hand-written, with all their columns."""
    kinds = file_kinds(chunks).where(F.col("kind").isNotNull()).select(F.col("index_run_id").alias("_run"), F.col("file_path").alias("_path"))
    same = chunks["index_run_id"].eqNullSafe(kinds["_run"]) & plain_path(chunks["file_path"]).eqNullSafe(kinds["_path"])
    return chunks.join(kinds, same, "left_anti")


def p5_found(spark, sf_dir):
    return file_kinds(table(spark, sf_dir, "code_chunks")).where(F.col("kind").isNotNull()).select("index_run_id", "file_path")


def p5_kinds(spark, sf_dir):
    return file_kinds(table(spark, sf_dir, "code_chunks")).select(
        "index_run_id", "file_path", "language", "kind", "chars", "longest", "long_chars", "numeric_chars", "encoded_chars"
    )


def p5_hand_written(spark, sf_dir):
    return hand_written(table(spark, sf_dir, "code_chunks")).select("id", "index_run_id", "file_path", "name", "content")


def p5_files(spark, sf_dir):
    """Every file with its characters and lines, as the statistics add them up."""
    return file_kinds(table(spark, sf_dir, "code_chunks")).select("index_run_id", "file_path", "chars", "lines", "longest", "space", "letters")


QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds, "p5_hand_written": p5_hand_written, "p5_files": p5_files}
ORACLE = {
    "p5_files": r"""WITH c AS (SELECT index_run_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS file_path, content, list_transform(string_split(content, chr(10)), lambda x: length(x)) AS l FROM code_chunks)
SELECT index_run_id, file_path, sum(length(content))::BIGINT AS chars, sum(len(l))::BIGINT AS lines, max(list_max(l))::INT AS longest, sum(length(content) - length(regexp_replace(content, '[ \t\r\n]', '', 'g')))::BIGINT AS space,
 sum(length(content) - length(regexp_replace(content, '[A-Za-z0-9]', '', 'g')))::BIGINT AS letters FROM c GROUP BY 1, 2"""
}
