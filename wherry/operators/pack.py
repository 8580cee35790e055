"""Packing, evidence windows, chunking and context rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.functions.text import cut_bytes, estimate_tokens, first_line, identifier_words

FULL_BODIES = 6
WINDOW_LINES, WINDOW_STRIDE, MAX_WINDOWS, LONG_BODY = 10, 5, 64, 24
CHUNK_LINES, CHUNK_OVERLAP, MAX_CHUNKS, CHUNK_BYTES = 40, 10, 48, 4000
# Fixed value: the line that stands between windows of a body.
GAP = "\n// ...\n"


def pack(ranked: DataFrame, budget: int, cost: Column) -> DataFrame:
    """Keep each query's longest prefix whose costs (one at least) fit the budget; adds tokens and running."""
    rows = ranked.withColumn("tokens", F.greatest(cost, F.lit(1)))
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("running", run).filter(F.col("running") <= budget)


def compact_body(body: Column, signature: Column, docstring: Column) -> Column:
    """The signature, or the body's first line where there is none, and the first line of the documentation as a comment."""
    head = F.when(F.coalesce(signature, F.lit("")) != "", signature).otherwise(F.when(F.instr(body, "\n") > 1, first_line(body)).otherwise(body))
    doc = first_line(F.coalesce(docstring, F.lit("")))
    return F.when(doc == "", head).otherwise(F.concat(head, F.lit("\n// "), doc))


def tiered_body(rank: Column, body: Column, signature: Column, docstring: Column, full: int = FULL_BODIES) -> Column:
    """The body for the first results, the compact form below."""
    return F.when(rank <= full, body).otherwise(compact_body(body, signature, docstring))


def windows(bodies: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, start, end, lines): overlapping line windows of long bodies, 1-based; the stride grows so that about MAX_WINDOWS suffice."""
    rows = bodies.select(F.col(id_col).alias("id"), F.size(F.split(body, "\n")).alias("lines")).filter(F.col("lines") > LONG_BODY)
    few = F.floor(F.col("lines") / WINDOW_STRIDE) <= MAX_WINDOWS
    stride = F.when(few, F.lit(WINDOW_STRIDE)).otherwise((F.floor(F.col("lines") / MAX_WINDOWS) + 1).cast("int"))
    last = F.ceil((F.col("lines") - WINDOW_LINES) / stride).cast("int")
    made = rows.select("id", "lines", stride.alias("stride"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("k") * F.col("stride") + 1
    return made.select("id", start.alias("start"), F.least(start + WINDOW_LINES - 1, F.col("lines")).alias("end"), "lines")


SHORTLIST, TOP_WINDOWS, KEEP_RATIO = 8, 3, 0.6


def rank_windows(windows: DataFrame, query_vectors: DataFrame, shortlist: int = SHORTLIST) -> DataFrame:
    """Windows (query_id, id, start, v) scored by the dot product with their query's vector (query_id, qv).

    Adds score and n, the place among a result's windows (ties by start); windows beyond ``shortlist`` are left out
    (0: all are kept), which is what a cross-encoder would score anew.
    """
    from wherry.functions.vec import dot

    scored = windows.join(query_vectors.select("query_id", "qv"), "query_id").withColumn("score", dot(F.col("qv"), F.col("v"))).drop("qv")
    placed = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "start")))
    return placed.filter(F.col("n") <= shortlist) if shortlist > 0 else placed


def select_spans(scored: DataFrame, context: int = 3) -> DataFrame:
    """Spans of the windows that are shown: three at most for a query's first result, one for the others, widened by context lines.

    Beyond the best window the list ends at the first that scores less than 0.6 of it; a best score of zero or less tells
    nothing and lets all pass.
    """
    w = Window.partitionBy("query_id", "id")
    ranked = scored.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "start"))).withColumn("best", F.max("score").over(w))
    keep = F.when(F.col("rank") == 1, TOP_WINDOWS).otherwise(1)
    # Scores fall along n, so the windows that pass are a prefix.
    kept = ranked.filter((F.col("n") <= keep) & ((F.col("n") == 1) | (F.col("best") <= 0) | (F.col("score") >= KEEP_RATIO * F.col("best"))))
    return kept.select("query_id", "id", F.greatest(F.lit(1), F.col("start") - context).alias("start"), F.least(F.col("start") + WINDOW_LINES - 1 + context, F.col("lines")).alias("end"))


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Merge spans that overlap or touch (start not after the last end): gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    islands = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def render_spans(body: Column, spans: Column) -> Column:
    """Lines of a body in the given (start, end) spans, a gap mark between them."""
    lines = F.split(body, "\n")
    return F.array_join(F.transform(spans, lambda s: F.array_join(F.slice(lines, s["start"], s["end"] - s["start"] + 1), "\n")), GAP)


ELLIPSIS = " ..."


def truncated(c: Column, n: int) -> Column:
    """A field cut to n bytes, with dots where something was cut."""
    return F.when(F.octet_length(c) > n, F.concat(cut_bytes(c, n), F.lit(ELLIPSIS))).otherwise(c)


def text_head(qualified_name: Column, kind: Column, path: Column) -> Column:
    """``words - kind in words of the path`` and a line feed; parts without words are left out."""
    name, where = identifier_words(qualified_name), identifier_words(path)
    return F.concat(F.when(name != "", F.concat(name, F.lit(" - "))).otherwise(""), kind, F.when(where != "", F.concat(F.lit(" in "), where)).otherwise(""), F.lit("\n"))


def chunk_lines(docs: DataFrame, id_col: str, body: str, head: Column | None = None) -> DataFrame:
    """(id, chunk, start, end, text): overlapping windows of bodies of two lines or more, trimmed, cut and put behind a head.

    Blank windows are left out and do not count against MAX_CHUNKS; ``head`` is an expression over ``docs`` (none: no head).
    """
    step = CHUNK_LINES - CHUNK_OVERLAP
    rows = docs.select(F.col(id_col).alias("id"), F.split(body, "\n").alias("lines"), (F.lit("") if head is None else head).alias("head")).filter(F.size("lines") >= 2)
    n = F.size("lines")
    count = F.when(n <= CHUNK_LINES, 1).otherwise(F.ceil((n - CHUNK_LINES) / step).cast("int") + 1)
    made = rows.select("id", "lines", "head", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    start = F.col("k") * step + 1
    text = F.btrim(F.array_join(F.slice("lines", start, F.lit(CHUNK_LINES)), "\n"), F.lit(" \t\n\x0b\f\r"))
    made = made.select("id", "k", "head", start.alias("start"), F.least(start + CHUNK_LINES - 1, n).alias("end"), text.alias("text")).filter("text != ''")
    placed = made.withColumn("chunk", F.row_number().over(Window.partitionBy("id").orderBy("k")) - 1).filter(F.col("chunk") < MAX_CHUNKS)
    return placed.select("id", "chunk", "start", "end", F.concat("head", truncated(F.col("text"), CHUNK_BYTES)).alias("text"))


# Fixed value: what ends an excerpt of a longer body.
TRUNCATED = "\n// ... [truncated]"


def cap_body(body: Column, cap: int = 2000, marker: str = TRUNCATED) -> Column:
    """A body cut to a number of bytes, with a marker where something was cut."""
    return F.when(F.octet_length(body) > cap, F.concat(cut_bytes(body, cap), F.lit(marker))).otherwise(body)


DOC_BYTES, SIGNATURE_BYTES, BODY_BYTES, NEIGHBOURS = 500, 300, 1600, 8


def embedding_text(qualified_name: Column, kind: Column, path: Column, language: Column, signature: Column, doc: Column, body: Column, neighbours: Column | None = None) -> Column:
    """The text that is embedded for a symbol: head, documentation, the first neighbours' words, then the fields that are not empty."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    field = lambda key, c: F.when(some(c), F.concat(F.lit(f"{key}: "), c, F.lit("\n"))).otherwise("")
    parts = [text_head(qualified_name, kind, path), F.when(some(doc), F.concat(truncated(doc, DOC_BYTES), F.lit("\n"))).otherwise("")]
    if neighbours is not None:
        words = F.slice(F.filter(F.transform(neighbours, identifier_words), lambda w: w != ""), 1, NEIGHBOURS)
        parts.append(F.when(F.size(words) > 0, F.concat(F.lit("related: "), F.array_join(words, ", "), F.lit("\n"))).otherwise(""))
    parts += [field("symbol", qualified_name), field("kind", kind), field("file", path), field("language", language), field("signature", truncated(F.coalesce(signature, F.lit("")), SIGNATURE_BYTES))]
    return F.concat(*parts, F.when(some(body), F.concat(F.lit("body:\n"), truncated(body, BODY_BYTES))).otherwise(""))


# What a line that decides between paths begins with.
BRANCH_PREFIXES = ("if ", "if(", "else", "switch ", "switch(", "case ", "case:", "default:", "select ", "match ", "when ")
BLANK = " \t\n\x0b\f\r"


def branch_control(line: Column) -> Column:
    t = F.btrim(line, F.lit(BLANK))
    found = F.lit(False)
    for p in BRANCH_PREFIXES:
        found = found | t.startswith(p)
    return found


def call_site(body: Column, first: Column, call: Column) -> Column:
    """Numbered lines around a call, three before and one after, if one of them up to the call is a branch; else empty.

    ``first``: number of the body's first line; ``call``: number of the call's. Blank lines are left out, long ones cut.
    """
    lines = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n")
    at = call - first
    low, high = F.greatest(F.lit(0), at - 3), F.least(at + 1, F.size(lines) - 1)
    good = (body != "") & (first > 0) & (at >= 0) & (at < F.size(lines))

    def shown(i: Column) -> Column:
        t = F.btrim(F.get(lines, i), F.lit(BLANK))
        return F.when(t != "", F.concat((first + i).cast("string"), F.lit(" "), F.when(F.char_length(t) > 120, F.concat(F.left(t, F.lit(120)), F.lit("…"))).otherwise(t)))

    sensitive = F.exists(F.slice(lines, low + 1, F.greatest(at - low + 1, F.lit(0))), branch_control)
    text = F.array_join(F.array_compact(F.transform(F.sequence(low, F.greatest(low, high)), shown)), " | ")
    return F.when(F.coalesce(good, F.lit(False)), F.when(sensitive, text).otherwise("")).otherwise("")


# How the parts of a rendered answer are told apart.
_HEADER, _GRAPH, _NUMBER = r"^\d+\. \*\*", r"^(callers|callees|tests|siblings)", r"^(\d+\t)"
_EXPAND, _CALLSITE, _TEASER = r" \[excerpt [^\]]*\]", r" \[callsite: [^\]]*\]", " — "
_DISCLAIMER = " (path_status=static_unverified; verify branch/dispatch)"
_NUDGE = " (pass to record_feedback)"


def section_cost(rendered: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(section, tokens) of rendered answers: what each part costs, parts of parts being told besides their whole."""
    lines = rendered.select(F.col(id_col).alias("answer"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    fence = F.col("line").startswith("```")
    before = F.sum(fence.cast("int")).over(Window.partitionBy("answer").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumns({"fence": fence, "code": F.coalesce(before, F.lit(0)) % 2 == 1})
    line, cost = F.col("line"), estimate_tokens(F.col("line"))
    part = lambda name, tokens: F.struct(F.lit(name).alias("section"), tokens.cast("long").alias("tokens"))
    found = lambda pattern: estimate_tokens(F.regexp_extract(line, pattern, 0))
    at = F.instr(line, _TEASER)
    teaser = F.when(at > 0, estimate_tokens(F.substring(line, at, F.char_length(line)))).otherwise(0)
    sites = F.aggregate(F.regexp_extract_all(line, F.lit(_CALLSITE), 0), F.lit(0).cast("long"), lambda a, s: a + estimate_tokens(s))
    boiler = F.when(F.contains(line, F.lit(_DISCLAIMER)), (len(_DISCLAIMER) + 3) // 4).otherwise(0)
    blank = F.btrim(line, F.lit(BLANK)) == ""
    parts = (
        F.when(F.col("fence"), F.array(part("fences_and_blanks", cost)))
        .when(F.col("code"), F.array(part("code", cost), part("line_numbers", found(_NUMBER))))
        .when(blank, F.array(part("fences_and_blanks", cost)))
        .when(line.startswith("req:"), F.array(part("request_id", cost)))
        .when(line.rlike(_HEADER), F.array(part("result_header", cost - teaser), part("expand_hint", found(_EXPAND)), part("compact_teaser", teaser)))
        .when(line.rlike(_GRAPH), F.array(part("graph_refs", cost), part("path_status", boiler), part("callsites", sites)))
        .when(line.startswith("companions:"), F.array(part("companions", cost)))
        .when(line.startswith("flow:"), F.array(part("flow_context", cost)))
        .when(line.startswith("note:"), F.array(part("confidence_note", cost)))
        .otherwise(F.array(part("fences_and_blanks", cost)))
    )
    nudges = rendered.filter(F.contains(text, F.lit(_NUDGE))).select(F.lit("feedback_nudge").alias("section"), F.lit((len(_NUDGE) + 3) // 4).cast("long").alias("tokens"))
    return rows.select(F.inline(parts)).unionByName(nudges).groupBy("section").agg(F.sum("tokens").alias("tokens"))


def companions(files: DataFrame) -> DataFrame:
    """(query_id, file, companion, n): up to four files of an answer that go with another by name."""
    d = F.coalesce(F.nullif(F.regexp_extract("file", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    b = F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=.)\.[^.]*$", "")
    base = F.concat(d, F.lit("/"), b)
    patterns = [F.concat(base, F.lit(s)) for s in ("_test.go", "_mock.go", ".test.ts", ".test.tsx", ".spec.ts", ".gen.go")] + [F.concat(d, F.lit("/mocks/"), b, F.lit(".go"))]
    want = files.select("query_id", "file", F.posexplode(F.array(*patterns)).alias("pos", "companion"))
    have = files.select("query_id", F.col("file").alias("companion")).distinct()
    found = want.join(have, ["query_id", "companion"], "left_semi")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "file").orderBy("pos"))).filter("n <= 4").select("query_id", "file", "companion", "n")


def page_text(text: str, offset: int = 0, limit: int = 48 * 1024) -> tuple[str, int]:
    """A page of at most ``limit`` bytes from a byte offset, ended at a line feed where there is one, never within a character."""
    raw = text.encode("utf-8")
    end = min(len(raw), offset + limit)
    if end < len(raw):
        cut = raw.rfind(b"\n", offset, end)
        end = cut + 1 if cut > offset else end
        while end > offset and raw[end] & 0xC0 == 0x80:
            end -= 1
    return raw[offset:end].decode("utf-8"), end


def expansion_page(text: str, offset: int = 0, limit: int = 48 * 1024) -> dict:
    """A page of an expanded body with where it lies: offsets in bytes, line and column of its start, the whole text's digest, whether more follows."""
    import hashlib

    page, end = page_text(text, offset, limit)
    raw = text.encode("utf-8")
    before = raw[:offset].decode("utf-8", "ignore")
    return {
        "text": page, "offset": offset, "next": end if end < len(raw) else None, "line": before.count("\n") + 1, "column": len(before) - (before.rfind("\n") + 1) + 1,
        "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw),
    }
