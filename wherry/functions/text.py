"""Text functions as column expressions: tokenizers, stemmer, identifiers, sizes and paths.

Everything here stays inside Catalyst; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a full-text query leaves out.
FTS_STOPWORDS = (
    "a an the is are was were be do does in on at to of for with where how what why when we our my this that these those it its"
).split()

# Whole-token replacements before suffix stripping, for overlap features.
OVERLAP_FORMS = {
    "children": "child", "employees": "employee", "indices": "index",
    "initialized": "new", "initialize": "new", "initializes": "new", "init": "new",
}

# Whole-token replacements before suffix stripping, for intent matching.
INTENT_FORMS = {
    "employees": "employee", "children": "child", "indices": "index", "symbols": "symbol", "edges": "edge", "files": "file",
    "opened": "new", "open": "new", "created": "new", "create": "new", "initialized": "new", "init": "new",
    "construct": "new", "constructed": "new", "instantiate": "new", "instantiated": "new",
    "golang": "go", "ts": "typescript",
}

SUFFIXES = ("ing", "ed", "es", "s")
BLANKS = " \t\n\x0b\f\r"

# Words that never name code.
LITERAL_STOPWORDS = (
    "e.g i.e etc vs self true false none null the and for with this that when then should github.com readme.md python javascript"
).split()


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def octets(c: Column) -> Column:
    return F.octet_length(c)


def estimate_tokens(c: Column) -> Column:
    """Token estimate of a text: a quarter of its bytes, rounded up."""
    return F.floor((F.octet_length(F.coalesce(c, F.lit(""))) + 3) / 4).cast("long")


def bm25_tokens(c: Column) -> Column:
    """Lowered runs of letters, digits and underscores, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def camel_pieces(word: Column) -> Column:
    """A word cut at its underscores, or else before every ASCII capital but the first character."""
    return F.when(word.contains("_"), F.split(word, "_")).otherwise(F.split(word, "(?<=.)(?=[A-Z])"))


def fts_terms(c: Column) -> Column:
    """Distinct terms of a full-text query in order: words and, for compound ones, their pieces; case counts."""
    stop = lit_array(FTS_STOPWORDS)
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0)
    words = F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, F.lower(w)))

    def expand(w: Column) -> Column:
        pieces = camel_pieces(w)
        kept = F.filter(pieces, lambda p: (F.octet_length(p) >= 2) & ~F.array_contains(stop, F.lower(p)))
        return F.when(F.size(pieces) <= 1, F.array(w)).otherwise(F.concat(F.array(w), kept))

    return F.array_distinct(F.flatten(F.transform(words, expand)))


def fts_query(c: Column) -> Column:
    """The terms, quoted and joined by OR."""
    return F.array_join(F.transform(fts_terms(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def strip_suffix(tok: Column) -> Column:
    """ies to y in words of over four bytes, else the first of ing, ed, es, s that leaves over three."""
    out = tok
    n = F.octet_length(tok)
    for s in reversed(SUFFIXES):
        out = F.when((n > len(s) + 3) & tok.endswith(s), F.substring(tok, F.lit(1), F.char_length(tok) - len(s))).otherwise(out)
    return F.when((n > 4) & tok.endswith("ies"), F.concat(F.substring(tok, F.lit(1), F.char_length(tok) - 3), F.lit("y"))).otherwise(out)


def normal_form(tok: Column, forms: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.coalesce(F.get(F.array(F.element_at(table, tok)), F.lit(0)), strip_suffix(tok))


def overlap_tokens(c: Column) -> Column:
    """Distinct normalised tokens for overlap features, in order; acronyms split before their last capital."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})", " ")
    toks = F.regexp_extract_all(F.lower(spaced), F.lit(r"[\p{L}\p{Nd}]+"), 0)
    return F.array_distinct(F.filter(F.transform(toks, lambda t: normal_form(t, OVERLAP_FORMS)), lambda t: F.octet_length(t) >= 2))


def intent_tokens(c: Column) -> Column:
    """Distinct normalised tokens for intent matching."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", " ")
    toks = F.regexp_extract_all(F.lower(spaced), F.lit(r"[\p{L}\p{Nd}]+"), 0)
    return F.array_distinct(F.transform(F.filter(toks, lambda t: F.octet_length(t) >= 2), lambda t: normal_form(t, INTENT_FORMS)))


def overlap_ratio(query_tokens: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has."""
    n = F.size(query_tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_tokens, overlap_tokens(text))) / n)


def query_identifiers(c: Column, limit: int = 8) -> Column:
    """Names of code in a question: backticked, snake and camel case; one token of 4 to 60 characters; first spelling kept."""
    text = F.coalesce(c, F.lit(""))
    found = F.flatten(
        F.array(
            F.regexp_extract_all(text, F.lit("`([^`\n]{2,80})`"), 1),
            F.regexp_extract_all(text, F.lit(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), 0),
            F.regexp_extract_all(text, F.lit(r"\b[a-z]+[A-Z][A-Za-z0-9]*\b|\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*\b"), 0),
        )
    )
    trimmed = F.transform(found, lambda s: F.btrim(s, F.lit("`.,;:()[]{}\"'")))
    kept = F.filter(trimmed, lambda s: F.octet_length(s).between(4, 60) & ~F.array_contains(lit_array(LITERAL_STOPWORDS), F.lower(s)) & s.rlike("^[A-Za-z0-9_]+$"))
    lowered = F.transform(kept, lambda s: F.lower(s))
    first = F.filter(kept, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1)
    return F.slice(first, 1, limit)


def identifier_words(c: Column) -> Column:
    """A qualified name as natural language: separators and case changes become blanks, lowered."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.lower(F.btrim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def short_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def normal_path(c: Column) -> Column:
    """Forward slashes, without a leading ./ and then a leading /."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", ""), "^/", "")


def file_dir(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def file_stem(c: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")


def file_ext(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(c, "/", -1), r"\.([^.]*)$", 1))


def bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once: an expression that is used several times grows with each step that is put on it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def cut_bytes(c: Column, n: int) -> Column:
    """The first n bytes of a text; a character that the cut would split goes whole."""
    raw = c.cast("binary")
    inside = lambda k: F.left(F.hex(F.substring(raw, k + 1, 1)), F.lit(1)).isin("8", "9", "A", "B")
    size = F.when(~inside(n), n).when(~inside(n - 1), n - 1).when(~inside(n - 2), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(raw, F.lit(1), size), "utf-8"))


# Tokens of comment syntax that are no words of a sentence, and the marks that are cut from the others.
COMMENT_TOKENS = ("//", "///", "/*", "/**", "*", "*/", '"""', "'''", "#")
SENTENCE_BYTES = 220


def first_sentence(c: Column) -> Column:
    """The first sentence of the first paragraph without comment syntax: up to the first stop that a blank follows, 220 bytes at most."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    at = F.instr(t, "\n\n")
    paragraph = F.when(at > 1, F.left(t, at - 1)).otherwise(t)
    fields = F.filter(F.split(paragraph, r"\s+"), lambda f: ~f.isin("", *COMMENT_TOKENS))
    words = F.array_join(F.transform(fields, lambda f: F.regexp_replace(F.regexp_replace(f, '^"""', ""), "^'''", "")), " ")
    stop = F.instr(words, ". ")
    return cut_bytes(F.when(stop > 1, F.left(words, stop)).otherwise(words), SENTENCE_BYTES)


def strip_leading_name(sentence: Column, name: Column) -> Column:
    """A sentence without the symbol's own name in front, whatever its case; a lone name stays."""
    fields = F.filter(F.split(sentence, r"\s+"), lambda f: f != "")
    leads = (F.size(fields) > 1) & (F.lower(F.get(fields, F.lit(0))) == F.lower(name))
    return F.when(leads, F.array_join(F.slice(fields, F.lit(2), F.size(fields)), " ")).otherwise(sentence)


def clean_subject(c: Column) -> Column:
    """A commit subject without its conventional prefix, its issue numbers and a path in front."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[a-z]+(\([^)]*\))?[:!]\s*", ""), r"\(?#\d+\)?", "")
    at = F.instr(bare, ": ")
    path = (at > 1) & ~F.contains(F.left(bare, at - 1), F.lit(" "))
    return F.btrim(F.when(path, F.substring(bare, at + 2, F.char_length(bare))).otherwise(bare), F.lit(" \t\n\x0b\f\r"))


def is_compound(subject: Column) -> Column:
    """Whether a subject bundles several changes: two commas, a plus sign between blanks, or a semicolon."""
    return (F.regexp_count(subject, F.lit(",")) >= 2) | F.contains(subject, F.lit(" + ")) | F.contains(subject, F.lit(";"))


_SPAN = r"^\s*(\+?\d+)\s*-\s*([+-]?\d+)\s*$"


def parse_spans(c: Column) -> Column:
    """Array of (start, end) of the ranges in a list like 3-9,14-20; what is no range is left out."""
    parts = F.filter(F.split(c, ","), lambda p: p.rlike(_SPAN))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, _SPAN, 1).cast("int").alias("start"), F.regexp_extract(p, _SPAN, 2).cast("int").alias("end")))


def parse_span(c: Column) -> Column:
    """(start, end) of one range that does not run backwards, else null."""
    start, end = (F.try_to_number(F.nullif(F.regexp_extract(c, _SPAN, k), F.lit("")), F.lit("S999999999")).cast("int") for k in (1, 2))
    return F.when(c.rlike(_SPAN) & (start <= end), F.struct(start.alias("start"), end.alias("end")))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def redact(c: Column) -> Column:
    """A repeatable stand-in for a text, so that joins survive redaction; an empty text stays empty."""
    return F.when(c == "", c).otherwise(F.concat(F.lit("h:"), F.left(sha256_hex(c), F.lit(12))))


# Patterns of names of code in prose, by form, and headings that are no title.
BACKTICKED = "`([^`\n]{2,80})`"
CODE_FORMS = (
    r"\b[\w.-]+(?:/[\w.-]+)+\.\w{1,5}\b",
    r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    r"\b[a-z]+[A-Z][A-Za-z0-9]*\b|\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*\b",
    r"\b[a-z][\w]*(?:\.[a-z][\w]*){1,4}\b",
)
HEADINGS = (
    "title", "description", "summary", "steps to reproduce", "step to reproduce", "expected behavior", "expected behaviour",
    "current behavior", "current behaviour", "actual behavior",
)
CODE_STOPWORDS = "e.g i.e etc vs self true false none null the and for with this that when then should github.com readme.md".split()


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value made once for a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def code_identifiers(c: Column, limit: int) -> Column:
    """Names of code in a text, the author's own marks first, then paths, snake, camel and dotted names; each once, whatever its case.

    Once a form has filled the list, later forms are not looked for.
    """
    text = F.coalesce(c, F.lit(""))

    def found(pattern: str, group: int = 0) -> Column:
        trimmed = F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda s: F.btrim(s, F.lit("`.,;:()[]{}\"'")))
        return F.filter(trimmed, lambda s: F.octet_length(s).between(3, 80) & ~F.lower(s).isin(*CODE_STOPWORDS))

    def once(names: Column) -> Column:
        return _let(names, lambda n: _let(F.transform(n, lambda s: F.lower(s)), lambda low: F.filter(n, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)))

    def longer(names: Column, form: str) -> Column:
        return _let(names, lambda n: F.when(F.size(n) >= limit, n).otherwise(once(F.concat(n, found(form)))))

    names = once(F.concat(found(BACKTICKED, 1), found(CODE_FORMS[0])))
    for form in CODE_FORMS[1:]:
        names = longer(names, form)
    return F.slice(names, 1, limit)


def issue_title(c: Column) -> Column:
    """The first line with words of its own: no heading mark, comment, fence or name of a section; the whole text if there is none."""
    blank = F.lit(" \t\r\x0b\x0c")
    lines = F.transform(F.split(c, "\n"), lambda x: F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(x, r"^#{1,6}\s*", ""), blank), ":$", ""), F.lit("")))
    good = F.filter(lines, lambda x: (x != "") & ~F.lower(x).isin(*HEADINGS) & ~x.startswith("<!--") & ~x.startswith("```"))
    return F.coalesce(F.get(good, F.lit(0)), F.btrim(c, F.lit(" \t\r\n\x0b\x0c")))


def shape_query(c: Column, mode: str = "raw") -> Column:
    """A report as a query: ``title``, ``ids``, ``title+ids`` or, by default, as it is."""
    if mode == "title":
        return issue_title(c)
    if mode == "ids":
        return F.array_join(code_identifiers(c, 24), " ")
    if mode == "title+ids":
        return F.concat_ws(" ", issue_title(c), F.nullif(F.array_join(code_identifiers(c, 16), " "), F.lit("")))
    return c


# Words of code that no probe asks for.
CODE_KEYWORDS = "func return range case else true false break continue default nil type struct interface import switch select defer string error".split()
PROBE_TOKENS = 8


def code_tokens(line: Column) -> Column:
    """Distinct words of four letters or more of a line of code, eight at most; none of short lines and comments."""
    t = F.btrim(line, F.lit(" \t\r"))
    spaced = F.regexp_replace(t, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", " ")
    words = F.filter(F.regexp_extract_all(F.lower(spaced), F.lit(r"[\p{L}\p{Nd}]+"), 0), lambda w: (F.octet_length(w) >= 4) & ~F.array_contains(lit_array(CODE_KEYWORDS), w))
    bare = (F.octet_length(t) < 12) | t.startswith("//") | t.startswith("*") | t.startswith("/*") | t.startswith("#")
    return F.when(bare, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(words), 1, PROBE_TOKENS))


def matches_category(category: Column, tags: Column, wanted: str) -> Column:
    """Whether a case's category or one of its tags contains a text."""
    return F.contains(F.coalesce(category, F.lit("")), F.lit(wanted)) | F.coalesce(F.exists(tags, lambda t: F.contains(t, F.lit(wanted))), F.lit(False))


# Where a summary starts to echo its instruction, words that are left hanging before it, labels, and its length.
ECHO_MARKERS = ("distinguish", "setting it apart", "sets it apart", "set it apart", "unlike similar", "unlike other", "compared to similar", "compared to other")
CONNECTORS = ("it", "which", "that", "this", "and", "thereby", "thus", "while", "also")
LABELS = ("Summary:", "summary:", "Purpose:", "purpose:")
SUMMARY_BYTES = 300


def strip_echo(c: Column) -> Column:
    """A summary without the clause that echoes its instruction, and without the words that hang before it."""

    def shortened(x: Column, cut: Column) -> Column:
        head = F.btrim(F.left(x, cut - 1), F.lit(BLANKS))
        # Connectors and marks go from the end as often as they come.
        head = F.regexp_replace(head, r"(?i)(?:[,;:\- ]* (?:" + "|".join(CONNECTORS) + r")(?=[,;:\- ]|$))*[,;:\- ]*$", "")
        return F.when(cut == 0, x).otherwise(bound(head, lambda h: F.when(h == "", x).when(h.endswith("."), h).otherwise(F.concat(h, F.lit(".")))))

    return bound(c, lambda x: bound(F.regexp_instr(F.lower(x), F.lit("|".join(ECHO_MARKERS))), lambda cut: shortened(x, cut)))


def clean_summary(c: Column) -> Column:
    """One plain line of a model's answer: no quotes, label or echo, and not too long."""
    t = F.btrim(F.btrim(c, F.lit(BLANKS)), F.lit("\"'`"))
    for label in LABELS:
        t = F.btrim(bound(t, lambda x, label=label: F.when(x.startswith(label), F.substring(x, len(label) + 1, 1 << 30)).otherwise(x)), F.lit(BLANKS))
    t = F.btrim(strip_echo(F.substring_index(t, "\n", 1)), F.lit(BLANKS))

    def short(head: Column) -> Column:
        before = F.regexp_replace(head, r" [^ ]*$", "")
        return F.when(F.contains(head, F.lit(" ")) & (F.octet_length(before) > SUMMARY_BYTES // 2), before).otherwise(head)

    return bound(t, lambda x: F.when(F.octet_length(x) > SUMMARY_BYTES, F.concat(bound(cut_bytes(x, SUMMARY_BYTES), short), F.lit(" ..."))).otherwise(x))
