"""Noise in text from scanned pages: running headers, page numbers, words broken over lines, misread letters.

Rows of the page table whose source_type is pdf in any case take part; rows with a null chunk_id
or text are left out, repeated rows count once, an empty table gives an empty result.  A null
source_path makes one document of its own; a null page sorts first.  Extra columns are ignored.

How it works: page lines are exploded in the JVM; lines at page edges are grouped by a key with
digits masked and confusable glyphs folded, and a key that recurs on other pages of its source
is a running header.  Words are counted over the whole corpus, grouped by confusable-glyph
skeleton, and a rare form whose group has a much more frequent form that its neighbours support
is a misreading of it.  Paragraphs are reflowed with SQL windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: A form must be this many times as frequent as the form it replaces; with this ratio context must support it, with the next one it need not.
RATIO, CLEAR_RATIO = 4, 200
#: Hyphen signs at the end of a line: hyphen-minus, hyphen, no-break hyphen, not sign (a soft hyphen in some encodings), soft hyphen, dashes.
HYPHENS = "\\-\u2010\u2011\u00ac\u00ad\u2043\u2212\u2013"
#: Glyphs that recognition confuses, folded to one; digraphs that look like one letter.
GLYPHS = (("ce", "c"), ("hb6", "b"), ("tf", "t"), ("gq9", "g"), ("o0", "o"), ("li1|r", "l"), ("s5", "s"))
DIGRAPHS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("in", "m"))


def fold_glyphs(col: Column) -> Column:
    return F.translate(F.lower(col), "".join(a for a, _ in GLYPHS), "".join(b * len(a) for a, b in GLYPHS))


def fold_digraphs(col: Column, rules: tuple = DIGRAPHS) -> Column:
    """One letter for each pair; a word's pairs may overlap, so callers fold in both orders."""
    for a, b in rules:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def page_lines(pages: DataFrame) -> DataFrame:
    """Non-blank lines (chunk_id, source_path, page, line_no, line, top, bottom, gap): place from either edge, blank line before."""
    pdf = pages.where((F.lower(F.trim("source_type")) == "pdf") & F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
    pdf = pdf.select("chunk_id", F.coalesce("source_path", F.lit("")).alias("source_path"), "page", "text").dropDuplicates(["chunk_id"])
    cut = pdf.withColumn("_l", F.split(F.col("text"), "\n")).drop("text")
    filled = cut.withColumn("_i", F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.length(F.trim(F.regexp_replace(F.get("_l", i), r"[\s\u00a0]+", " "))) > 0))
    return filled.select("chunk_id", "source_path", "page", F.size("_i").alias("_n"), "_l", "_i", F.posexplode("_i").alias("top", "_at")).select(
        "chunk_id",
        "source_path",
        "page",
        (F.col("_at") + 1).alias("line_no"),
        F.trim(F.regexp_replace(F.get("_l", F.col("_at")), r"\r$", "")).alias("line"),
        "top",
        (F.col("_n") - 1 - F.col("top")).alias("bottom"),
        ((F.col("top") > 0) & (F.get("_i", F.col("top") - 1) < F.col("_at") - 1)).alias("gap"),
    )


_NUMBER = r"(?<![A-Za-z0-9])[0-9lOIoSB]*[0-9lOI][0-9lOIoSB.]*(?![A-Za-z0-9])"
_ROMAN = r"^[ivxlcIVXLC1]{1,9}$"
_PAGE_NO = r"^(?:[Pp](?:age|aqe|agc|aqc|g)?\.?\s*|[-\u2013\u2014~\[(<|\u2022*=]+\s*)?([0-9lOIoSBi]*[0-9lOI][0-9lOIoSBi]*)(?:\s*(?:of|ot|/|von)\s*[0-9lOIoSBi]+)?(?:\s*[-\u2013\u2014~\])>|\u2022*=.]+)?$"


def classified(lines: DataFrame) -> DataFrame:
    """Adds kind: header, pageno or body."""
    edges = lines.where("top <= 3 or bottom <= 2")
    words = F.regexp_replace(F.regexp_replace("line", _NUMBER, " "), r"(?i)\bre[vu]\b|[^\p{L}0-9]+", " ")
    key = F.trim(F.regexp_replace(fold_glyphs(fold_digraphs(F.lower(words))), r"[^a-z]+", " "))
    single = F.trim(F.regexp_replace(fold_glyphs(words), r"[^a-z]+", " "))
    side = F.when(F.col("top") <= 3, "t").otherwise("b")
    plain = ~F.col("line").rlike(r"\d|[|\u2014]|(?i)\brev\b")
    chapter = (F.col("top") <= 1) & F.lower(fold_glyphs(F.col("line"))).rlike(r"^cbaptcl\s+\S{1,4}\s*[:.;]\s*\S")
    number = F.translate(F.regexp_extract("line", _PAGE_NO, 1), "lIiOoSB", "1110058")
    edges = edges.select("*", key.alias("_key"), single.alias("_single"), side.alias("_side"), plain.alias("_plain"), chapter.alias("_chapter"), number.alias("_num"))
    edges = edges.withColumn("_value", F.expr("try_cast(_num as bigint)"))
    edges = edges.withColumn("_bare", F.col("line").rlike(r"^[0-9lOIoSBi]+$") & F.col("_value").isNotNull())
    edges = edges.withColumn("_roman", F.col("line").rlike(_ROMAN) & F.col("_value").isNull() | F.col("line").rlike(r"^[ivxlc]+$"))
    by_key = W.partitionBy("source_path", "_key")
    first_page = F.min("page").over(W.partitionBy("source_path"))
    by_single = W.partitionBy("source_path", "_single")
    for name, part in (("_key", by_key), ("_single", by_single)):
        edges = edges.withColumn(f"_n{name}", F.size(F.collect_set(F.when(F.length(name) >= 6, F.col("page"))).over(part)))
    edges = edges.withColumn("_pages", F.greatest("_n_key", "_n_single"))
    edges = edges.withColumn("_first", F.coalesce(F.col("page") == first_page, F.lit(False)))
    page = W.partitionBy("chunk_id")
    number_like = F.col("line").rlike(_PAGE_NO)
    recurs = (F.col("_pages") >= 2) & (F.length("_key") >= 6) & ~F.col("line").rlike(r"^\d+(\.\d+)+\s") & ~number_like
    # headers lie at the very edge, or next to a header or page number there
    edge = recurs | F.col("_chapter") | number_like
    opened = F.max(F.when((F.col("top") == 0) & edge, 1).otherwise(0)).over(page) > 0
    closed = F.max(F.when((F.col("bottom") == 0) & edge, 1).otherwise(0)).over(page) > 0
    heads = recurs & ((F.col("top") == 0) | (F.col("bottom") == 0) | ((F.col("top") == 1) & opened) | ((F.col("bottom") == 1) & closed))
    edges = edges.withColumn("_head", heads | F.col("_chapter"))
    # the heading of the first page: the last plain line of the title at the page's top
    titles = W.partitionBy("chunk_id", "_key")
    heading = F.col("_first") & F.col("_plain") & (F.col("_side") == "t") & ~F.col("_chapter")
    edges = edges.withColumn("_heading", heading & (F.col("top") == F.max(F.when(heading, F.col("top"))).over(titles)))
    edges = edges.withColumn("_head", F.col("_head") & ~F.col("_heading"))
    # page numbers: at an edge, or next to an edge that a header holds
    top_heads = F.max(F.when(F.col("_head") & (F.col("top") == 0), 1).otherwise(0)).over(page)
    bottom_heads = F.max(F.when(F.col("_head") & (F.col("bottom") == 0), 1).otherwise(0)).over(page)
    at_edge = (F.col("top") <= top_heads) | (F.col("bottom") <= bottom_heads)
    shift = F.col("_value") - F.col("page")
    same_shift = F.size(F.collect_set(F.when(F.col("_bare") & at_edge, F.col("page"))).over(W.partitionBy("source_path", shift, F.col("_side"))))
    decorated = F.col("_value").isNotNull() & ~F.col("_bare")
    is_no = at_edge & ~F.col("_head") & (decorated | (F.col("_bare") & ((shift == 0) | (same_shift >= 2))) | F.col("_roman"))
    edges = edges.withColumn("kind", F.when(F.col("_head"), "header").when(is_no, "pageno"))
    kinds = edges.where("kind is not null").select("chunk_id", "line_no", "kind")
    return lines.join(kinds, ["chunk_id", "line_no"], "left").withColumn("kind", F.coalesce("kind", F.lit("body")))


_WORD = r"[A-Za-z0-9]+"
_LAST = rf"([A-Za-z0-9-]*[A-Za-z0-9])[{HYPHENS}]$"
_NEXT = r"^([a-z0-9A-Z]+)((?:-[A-Za-z0-9]+)*)"


def _words(col: Column) -> Column:
    """Lower-case words of a line; names of registers and numbers are left out."""
    bare = F.regexp_replace(col, r"\b\w*_\w*\b", " ; ")
    return F.filter(F.regexp_extract_all(F.lower(bare), F.lit(rf"({_WORD}|[.;:?!,()])"), 1), lambda x: x.rlike("[a-z]") | x.rlike("^[.;:?!,()]$"))


def _by_page():
    return W.partitionBy("source_path").orderBy(F.col("page").asc_nulls_first(), "chunk_id")


def neighbours(rows: DataFrame, ahead: Column, behind: Column) -> DataFrame:
    """Adds _next and _before: ``ahead`` of the next and ``behind`` of the previous row of the source, over page ends.

    Windows over rows stay inside a page; only one row per page goes to the window over a source, so
    that a large source doesn't sort all its lines in one task.
    """
    inner = W.partitionBy("chunk_id").orderBy("line_no")
    d = rows.withColumns({"_a": ahead, "_b": behind})
    d = d.withColumns({"_an": F.lead("_a").over(inner), "_bn": F.lag("_b").over(inner), "_last": F.lead("line_no").over(inner).isNull(), "_first": F.lag("line_no").over(inner).isNull()})
    ends = d.groupBy("source_path", "page", "chunk_id").agg(F.min_by("_a", "line_no").alias("_fa"), F.max_by("_b", "line_no").alias("_lb"))
    ends = ends.select("chunk_id", F.lead("_fa").over(_by_page()).alias("_na"), F.lag("_lb").over(_by_page()).alias("_pb"))
    d = d.join(ends, "chunk_id", "left")
    return d.withColumns({"_next": F.when(F.col("_last"), F.col("_na")).otherwise(F.col("_an")), "_before": F.when(F.col("_first"), F.col("_pb")).otherwise(F.col("_bn"))}).drop("_a", "_b", "_an", "_bn", "_last", "_first", "_na", "_pb")


def body_lines(lines: DataFrame) -> DataFrame:
    """Body lines with what a word broken at their end leaves on them and on the next body line."""
    body = lines.where("kind = 'body'").select("chunk_id", "source_path", "page", "line_no", "line", "gap", "top")
    body = neighbours(body, F.struct("chunk_id", "line_no", "line"), F.col("line"))
    head = F.regexp_extract("line", _LAST, 1)
    tail = F.regexp_extract("_next.line", _NEXT, 1)
    ends = F.col("line").rlike(rf"[A-Za-z0-9][{HYPHENS}]$") & (F.length(tail) > 0) & ~F.col("line").rlike(rf"_\w*[{HYPHENS}]$")
    cont = F.col("_before").rlike(rf"[A-Za-z0-9][{HYPHENS}]$") & ~F.col("_before").rlike(rf"_\w*[{HYPHENS}]$") & F.col("line").rlike("^[A-Za-z0-9]")
    body = body.select(
        "*", F.coalesce(ends, F.lit(False)).alias("_ends"), F.coalesce(cont, F.lit(False)).alias("_cont"), head.alias("_head"), tail.alias("_tail"), F.regexp_extract("_next.line", _NEXT, 2).alias("_more"),
        F.regexp_extract("line", rf"([{HYPHENS}])$", 1).alias("_sign"),
    )
    return body


def _verdicts(body: DataFrame, counts: DataFrame) -> DataFrame:
    """Whether a line's broken word is one word (hyphen) or a compound that ends the line at its own hyphen."""
    last = F.regexp_extract("_head", r"([A-Za-z0-9]+)$", 1)
    broken = body.where("_ends").select(
        "chunk_id", "line_no", "_sign", F.lower(F.concat(last, "_tail")).alias("joined"), F.lower(F.concat_ws("-", last, "_tail")).alias("compound"), F.lower(last).alias("_a"), F.lower("_tail").alias("_b"),
        F.length(last).alias("cut"), F.col("_next.chunk_id").alias("next_chunk"), F.col("_next.line_no").alias("next_line"),
    )
    c = counts.select("form", "n")
    for name in ("joined", "compound", "_a", "_b"):
        broken = broken.join(c.select(F.col("form").alias(name), F.col("n").alias(f"n{name}")), name, "left")
    broken = broken.withColumns({f"n{x}": F.coalesce(f"n{x}", F.lit(0)) for x in ("joined", "compound", "_a", "_b")})
    # a misread broken word: look up its skeletons
    skeletons = counts.where("n >= 3").select(fold_glyphs(fold_digraphs(F.col("form"))).alias("_s"), "n", F.col("form").contains("-").alias("_c"))
    best = skeletons.groupBy("_s", "_c").agg(F.max("n").alias("_m"))
    unknown = broken.where("njoined = 0 and ncompound = 0").select("chunk_id", "line_no", "joined", "compound")
    for name in ("joined", "compound"):
        part = best.where(F.col("_c") == (name == "compound")).select("_s", F.col("_m").alias(f"s{name}"))
        unknown = unknown.withColumn("_s", fold_glyphs(fold_digraphs(F.col(name)))).join(part, "_s", "left").drop("_s")
    broken = broken.join(unknown.select("chunk_id", "line_no", "sjoined", "scompound"), ["chunk_id", "line_no"], "left")
    j = F.when(F.col("njoined") + F.col("ncompound") > 0, F.col("njoined")).otherwise(F.coalesce("sjoined", F.lit(0)))
    k = F.when(F.col("njoined") + F.col("ncompound") > 0, F.col("ncompound")).otherwise(F.coalesce("scompound", F.lit(0)))
    both_words = (F.col("n_a") >= 3) & (F.col("n_b") >= 3)
    one = F.when(j + k > 0, j >= k).otherwise(~both_words)
    return broken.withColumn("one", one)


def noise(pages: DataFrame) -> dict[str, DataFrame]:
    """All parts: lines (classified), breaks (line ends judged), misread (tokens with their correction)."""
    lines = written(classified(page_lines(pages)), "lines")
    body = written(body_lines(lines), "body")
    # words of a line without the parts of broken words
    inner = F.when(F.col("_ends"), F.regexp_replace("line", rf"[A-Za-z0-9]+[{HYPHENS}]$", "")).otherwise(F.col("line"))
    inner = F.when(F.col("_cont"), F.regexp_replace(inner, r"^[A-Za-z0-9]+", "")).otherwise(inner)
    whole = body.select(F.explode(_words(inner)).alias("form"))
    compounds = body.select(F.explode(F.regexp_extract_all(F.lower(inner), F.lit(r"(?<![\w-])([a-z0-9]+(?:-[a-z0-9]+)+)"), 1)).alias("form"))
    pairs = compounds.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("form", "-")) - 1), lambda i: F.concat_ws("-", F.get(F.split("form", "-"), i - 1), F.get(F.split("form", "-"), i)))).alias("form"))
    counts = written(whole.where("form rlike '[a-z]'").unionByName(pairs).groupBy("form").agg(F.count("*").alias("n")), "counts")
    breaks = written(_verdicts(body, counts), "breaks")
    # the token stream of each line, broken words joined on their first line
    marks = breaks.select("chunk_id", "line_no", "joined", "one", "cut", "next_chunk", "next_line", "_a", "_b")
    entering = breaks.select(F.col("next_chunk").alias("chunk_id"), F.col("next_line").alias("line_no"), F.col("one").alias("_in"))
    b = body.join(marks, ["chunk_id", "line_no"], "left").join(entering, ["chunk_id", "line_no"], "left")
    text = F.when(F.col("one"), F.regexp_replace("line", rf"[A-Za-z0-9]+[{HYPHENS}]$", "")).otherwise(F.col("line"))
    text = F.when(F.col("_in"), F.regexp_replace(text, r"^[A-Za-z0-9]+", "")).otherwise(text)
    stream = F.concat(_words(text), F.when(F.col("one"), F.array("joined")).otherwise(F.array().cast("array<string>")))
    b = b.withColumn("_w", stream).drop("_next", "_before")
    b = neighbours(b, F.get("_w", F.lit(0)), F.element_at(F.when(F.size("_w") > 0, F.col("_w")), -1)).withColumnsRenamed({"_before": "_p", "_next": "_f"})
    b = b.withColumn("_all", F.concat(F.array(F.coalesce("_p", F.lit("."))), "_w", F.array(F.coalesce("_f", F.lit(".")))))
    tokens = b.where(F.size("_w") > 0).select(
        "chunk_id", "line_no", "next_chunk", "next_line", "one", "cut", F.size("_w").alias("_n"), "_all", F.posexplode("_w").alias("_k", "word")
    ).select(
        "chunk_id", "line_no", "next_chunk", "next_line", F.when(F.col("one") & (F.col("_k") == F.col("_n") - 1), F.col("cut")).alias("cut"), "word",
        F.get("_all", F.col("_k")).alias("before"), F.get("_all", F.col("_k") + 2).alias("after"),
    ).where("word rlike '[a-z]'")
    tokens = written(tokens, "tokens")
    return {"lines": lines, "body": body, "breaks": breaks, "tokens": tokens, "misread": misread_tokens(tokens)}


def misread_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that are misreadings, with the form they stand for."""
    counts = tokens.groupBy("word").agg(F.count("*").alias("n")).where("length(word) >= 2")
    keyed = counts.select("word", "n", F.explode(skeletons(F.col("word"))).alias("key"))
    forms = keyed.where((F.col("n") >= RATIO) & F.col("word").rlike("^[a-z]+$")).select("key", F.col("word").alias("form"), F.col("n").alias("form_n"))
    options = keyed.join(forms, "key").where(F.col("form_n") >= RATIO * F.col("n")).select("word", "n", "form", "form_n").distinct()
    options = written(options, "options")
    odd = tokens.join(options, "word")
    bigrams = tokens.select(F.col("before").alias("a"), F.col("word").alias("b")).where("a is not null")
    wanted = odd.select(F.col("before").alias("a"), F.col("form").alias("b")).union(odd.select("form", "after")).union(odd.select("before", "word")).union(odd.select("word", "after")).distinct()
    known = bigrams.join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("c"))
    known = written(known, "bigrams")

    def support(left: str, right: str, name: str, df: DataFrame) -> DataFrame:
        return df.join(known.select(F.col("a").alias(left), F.col("b").alias(right), F.col("c").alias(name)), [left, right], "left")

    odd = support("before", "form", "f1", odd)
    odd = support("form", "after", "f2", odd)
    odd = support("before", "word", "w1", odd)
    odd = support("word", "after", "w2", odd)
    f, w = F.coalesce("f1", F.lit(0)) + F.coalesce("f2", F.lit(0)), F.coalesce("w1", F.lit(0)) + F.coalesce("w2", F.lit(0))
    odd = odd.withColumn("_f", f).withColumn("_w", w)
    digits = F.col("word").rlike("[0-9]") & F.col("word").rlike("[a-z]{2}")
    good = digits | (F.col("form_n") >= CLEAR_RATIO * F.col("n")) | (F.col("_f") > F.col("_w"))
    odd = odd.where(good)
    one = ["chunk_id", "line_no", "next_chunk", "next_line", "cut", "word", "before", "after"]
    return odd.groupBy(*one).agg(F.max_by("form", F.struct("_f", "form_n", "form")).alias("form"))


def skeletons(col: Column) -> Column:
    """Keys that a form shares with its misreadings: one for single glyphs, one for digraphs."""
    single = F.concat(F.lit("1"), fold_glyphs(col))
    double = F.concat(F.lit("2"), fold_glyphs(fold_digraphs(F.translate(F.lower(col), "01569", "oisbg"))))
    turned = F.concat(F.lit("3"), fold_glyphs(fold_digraphs(F.translate(F.lower(col), "01569", "oisbg"), DIGRAPHS[::-1])))
    return F.array(single, double, turned)


def noise_cases(pages: DataFrame) -> DataFrame:
    """(chunk_id, line_no, noise): header, pageno, hyphen and misread lines, each once."""
    parts = noise(pages)
    edge = parts["lines"].where("kind <> 'body'").select("chunk_id", "line_no", F.col("kind").alias("noise"))
    hyphen = parts["breaks"].where("one").select("chunk_id", "line_no", F.lit("hyphen").alias("noise"))
    wrong = parts["misread"]
    # a broken word is misread on the line that holds the first letter in which it differs from its form
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.length("word"), F.length("form"))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr("word", i, F.lit(1)) == F.substr("form", i, F.lit(1))), i).otherwise(k))
    second = F.col("cut").isNotNull() & (same >= F.col("cut"))
    misread = wrong.select(F.when(second, F.col("next_chunk")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(second, F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("noise"))
    return edge.unionByName(hyphen).unionByName(misread).distinct().select("chunk_id", F.col("line_no").cast("bigint").alias("line_no"), "noise")


def repaired(pages: DataFrame) -> DataFrame:
    """Paragraphs (source_path, paragraph, first_page, text): headers and page numbers out, broken words joined, misread words corrected.

    A paragraph ends at a blank line inside a page; text goes on over a page break unless the page's first body line follows a blank line and the text before it ends a sentence.
    """
    parts = noise(pages)
    fixes = parts["misread"].select("chunk_id", "line_no", "word", "form").groupBy("chunk_id", "line_no").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "form")))).alias("_fix"))
    breaks = parts["breaks"].select("chunk_id", "line_no", "one", F.col("_b").alias("_rest"))
    entering = parts["breaks"].where("one").select(F.col("next_chunk").alias("chunk_id"), F.col("next_line").alias("line_no"), F.lit(True).alias("_in"))
    b = parts["body"].join(breaks, ["chunk_id", "line_no"], "left").join(entering, ["chunk_id", "line_no"], "left").join(fixes, ["chunk_id", "line_no"], "left")
    text = F.when(F.col("_in"), F.regexp_replace("line", r"^[A-Za-z0-9]+", "")).otherwise(F.col("line"))
    text = F.when(F.col("one"), F.concat(F.regexp_replace(text, rf"[{HYPHENS}]$", ""), F.col("_tail"))).when(F.col("one") == F.lit(False), F.concat(text, F.lit("\u0001"))).otherwise(text)
    text = F.when(
        F.col("_fix").isNotNull(), F.aggregate(F.map_entries("_fix"), text, lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b"), e["key"], F.lit(r"\b")), e["value"]))
    ).otherwise(text)
    b = b.withColumn("_t", F.trim(text)).drop("_next", "_before")
    b = neighbours(b, F.col("line"), F.struct("page", "line", "chunk_id")).withColumnRenamed("_before", "_lag")
    new_page = F.col("_lag.chunk_id") != F.col("chunk_id")
    full = F.col("_lag.line").rlike(r"[.?!:]['\")]?$")
    starts = F.col("_lag").isNull() | (~new_page & F.col("gap")) | (new_page & full & F.col("line").rlike(r"^[A-Z0-9]") & F.col("gap"))
    # number of the paragraph: those begun on earlier pages, and those begun on this one so far
    b = b.withColumn("_n", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(W.partitionBy("chunk_id").orderBy("line_no")))
    begun = b.groupBy("source_path", "page", "chunk_id").agg(F.max("_n").alias("_m"))
    begun = begun.select("chunk_id", F.coalesce(F.sum("_m").over(_by_page().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    b = b.join(begun, "chunk_id").withColumn("paragraph", F.col("_n") + F.col("_off"))
    return b.groupBy("source_path", "paragraph").agg(
        F.min("page").alias("first_page"),
        # a compound goes on without a blank after its own hyphen
        F.regexp_replace(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("page", F.lit(-1)).alias("p"), "chunk_id", "line_no", F.col("_t").alias("t")))), lambda x: x["t"])), "\u0001 ?", "").alias("text"),
    )
