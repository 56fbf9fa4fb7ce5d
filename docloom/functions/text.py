"""Text functions as Spark columns (no Python at run time).

Java's ``\\s`` and ``\\w`` are ASCII unless ``(?U)`` stands in front; patterns
here set it where the semantics are Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\x{4e00}-\\x{9fff}]"

#: Headings that stand alone.
STANDALONE_HEADINGS = ["ABSTRACT", "ACKNOWLEDGMENTS", "APPENDIX", "CONCLUSION", "REFERENCES"]

#: Terms about internal image tools and what replaces them.
INTERNAL_TERMS = [
    (r"OCR\s*(?:显示|识别到|识别|读取到|读取|提取到|提取)", "图中显示"),
    (r"OCR\s*(?:文本|结果|内容)", "图中文字"),
    (r"通过\s*OCR\s*", ""),
    (r"根据\s*OCR\s*", "根据图中文字"),
    (r"VLM\s*(?:显示|识别到|识别|判断|分析)", "图中显示"),
    (r"视觉模型\s*(?:显示|识别到|识别|判断|分析)", "图中显示"),
    (r"图片理解工具\s*(?:显示|识别到|识别|判断|分析)", "图中显示"),
    (r"图像观察\s*(?:显示|识别到|识别|判断|分析)", "图中显示"),
    (r"\bOCR\s+shows\b", "The image shows"),
    (r"\bOCR\s+indicates\b", "The image shows"),
    (r"\bOCR\s+text\b", "visible text"),
    (r"\bdetected\s+by\s+OCR\b", "visible in the image"),
    (r"\bVLM\s+(?:shows|indicates|detects|identified)\b", "The image shows"),
    (r"\bimage\s+observation\s+(?:shows|indicates)\b", "The image shows"),
]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def normalize_paragraph(text: Column) -> Column:
    """Join hyphenated line breaks, turn line breaks into spaces, collapse blanks."""
    x = F.regexp_replace(strip(text), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    x = F.regexp_replace(x, r"(?U)\s*\n+\s*", " ")
    return strip(F.regexp_replace(x, r"[ \t]+", " "))


def normalize_lines(text: Column) -> Column:
    """CRLF to LF, blanks to one space, three or more LF to two, strip."""
    x = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def ws_normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s(?:\s+|(?<! ))", " "))  # a single blank stays as it is


#: Lower-case signs that case folding still changes: to one sign, or to several.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x10000)) if c.lower() == c != c.casefold()}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_MORE = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def casefold_key(text: Column) -> Column:
    """White space to single blanks, then full case folding, so that texts that
    differ in case only are equal, final sigma and ligatures included."""
    one, rest = "".join(_ONE), "".join(c for c in _MORE if c != "ß")
    table = F.create_map(*[F.lit(t) for pair in _MORE.items() for t in pair])
    longer = lambda x: F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # what is rare costs only the texts that have it
    several = lambda x: F.when(x.rlike(f"[{rest}]"), longer(x)).when(F.contains(x, F.lit("ß")), F.replace(x, F.lit("ß"), F.lit("ss"))).otherwise(x)
    single = lambda x: F.when(x.rlike(f"[{one}]"), F.translate(x, one, "".join(_ONE.values()))).otherwise(x)
    return once(F.lower(ws_normalize(text)), lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), once(single(x), several)).otherwise(x))


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def preview(text: Column, limit: int = 240) -> Column:
    x = ws_normalize(text)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit), F.lit("...")))


def truncate_context(text: Column, limit: int) -> Column:
    """Cut at the last period, or line break, past 80 % of the limit."""
    cut = F.substring(text, 1, limit)
    back = F.reverse(cut)
    period = F.when(F.locate(".", back) > 0, F.length(cut) - F.locate(".", back) + 1).otherwise(0)
    line = F.when(F.locate("\n", back) > 0, F.length(cut) - F.locate("\n", back)).otherwise(-1)
    return (
        F.when(F.length(text) <= limit, text)
        .when(period - 1 > 0.8 * F.length(cut), cut.substr(F.lit(1), period))
        .when(line > 0.8 * F.length(cut), cut.substr(F.lit(1), line))
        .otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+\z", ""), F.lit("...")))
    )


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?U)(?<=[.!?。！？])\s+")
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def approx_token_count(text: Column) -> Column:
    """Pieces of at most four ASCII word characters; other signs one each."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), 1)
    pieces = F.aggregate(runs, F.lit(0).cast("long"), lambda n, w: n + F.ceil(F.length(w) / 4).cast("long"))
    n = pieces + F.regexp_count(text, F.lit(r"(?U)[^\sA-Za-z0-9_]"))
    return F.when((n == 0) & (F.length(text) > 0), F.lit(1).cast("long")).otherwise(n)


def language(text: Column) -> Column:
    return F.when(text.rlike(CJK), "zh").when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")


def looks_english(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    return (letters >= 10) & (letters > 3 * F.regexp_count(text, F.lit(CJK)))


def clean_answer(text: Column) -> Column:
    """Without emoji, bold marks and evidence references."""
    x = F.regexp_replace(text, "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}]\\x{fe0f}?", "")
    x = F.regexp_replace(x, r"\*\*(.*?)\*\*", "$1")
    x = F.regexp_replace(x, r"(?i)[<（(【\[]\s*(?:证据|資料|资料|片段|passage|evidence)\s*\d+\s*[>）)】\]]", "")
    return strip(x)


def clean_turn(text: Column) -> Column:
    """A question turn without trailing comma and outer quotes."""
    x = strip(text)
    x = F.when(x.endswith(","), strip(x.substr(F.lit(1), F.length(x) - 1))).otherwise(x)
    quoted = (F.length(x) >= 2) & x.startswith('"') & x.endswith('"')
    x = F.when(quoted, x.substr(F.lit(2), F.length(x) - 2)).otherwise(x)
    return strip(F.replace(x, F.lit('""'), F.lit('"')))


TURN_MODES = ("auto_newline", "single")


def turns(text: Column, mode: str = "auto_newline") -> Column:
    """Cleaned non-empty lines, or the cleaned whole if none is left; in mode
    ``single`` always the whole."""
    mode = (mode or TURN_MODES[0]).strip().lower()
    mode = {"auto": TURN_MODES[0], "newline": TURN_MODES[0], "single_turn": TURN_MODES[1]}.get(mode, mode)
    if mode not in TURN_MODES:
        raise ValueError(f"turn mode {mode!r} is none of {TURN_MODES}")
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.transform(F.split(unix, "\n"), clean_turn), lambda t: t != "")
    whole = F.filter(F.array(clean_turn(text)), lambda t: t != "")
    if mode != TURN_MODES[0]:
        return whole
    return F.when(F.size(lines) > 0, lines).otherwise(whole)


def coverage_tokens(text: Column) -> Column:
    low = F.lower(text)
    both = F.concat(F.regexp_extract_all(low, F.lit("([a-zA-Z0-9]+)"), 1), F.regexp_extract_all(low, F.lit(f"({CJK}{{2,}})"), 1))
    return F.array_distinct(F.filter(both, lambda t: F.length(t) >= 2))


def covers(candidate: Column, piece: Column) -> Column:
    """The piece shares at least min(3, size) tokens (one at least) with it."""
    c, p = coverage_tokens(candidate), coverage_tokens(piece)
    need = F.greatest(F.lit(1), F.least(F.lit(3), F.size(c)))
    return (F.size(c) == 0) | (F.size(F.array_intersect(c, p)) >= need)


def sanitize_terms(text: Column) -> Column:
    for pattern, put in INTERNAL_TERMS:
        text = F.regexp_replace(text, "(?i)" + pattern, put)
    return strip(text)


def strip_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""))


def image_ids(text: Column) -> Column:
    """Markdown, html and explicit image marks, as file stems, first seen first."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1),
        F.regexp_extract_all(text, F.lit(r"(?i)<img[^>]+src=[\"']([^\"']+)[\"'][^>]*>"), 1),
        F.regexp_extract_all(text, F.lit(r"[<\[]PIC[:：]([A-Za-z0-9_\-]+)[>\]]"), 1),
    )
    return F.array_distinct(F.filter(F.transform(found, stem), lambda s: s != ""))


def stem(path: Column) -> Column:
    """File name without directory, query, fragment and last extension."""
    value = F.regexp_replace(F.trim(path), r"[?#].*", "")
    name = F.regexp_extract(value, r"([^/]*)/*$", 1)
    return F.coalesce(F.nullif(F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name), F.lit("")), value)


def heading_level(text: Column, explicit: Column | None = None) -> Column:
    """Level of a heading line, null for body text."""
    label = F.regexp_extract(text, r"^(\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)[.)]?\s+\S.*$", 1)
    title = F.regexp_extract(text, r"^(?:\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)[.)]?\s+(\S.*)$", 1)
    upper = lambda x: (F.upper(_letters(x)) == _letters(x))
    words = F.size(F.split(ws_normalize(text), " "))
    level = F.size(F.split(label, r"\.")).cast("int")
    by_letter = F.when((_letters(title) != "") & upper(title) & ~F.contains(title, F.lit("=")), level)
    plain = F.when(F.upper(text).isin(STANDALONE_HEADINGS), 1).when(
        (words >= 2) & (F.length(_letters(text)) >= 4) & upper(text) & ~F.contains(text, F.lit("=")), 1
    )
    auto = F.when((F.length(text) > 160) | (words > 16), F.lit(None).cast("int")).when(label.rlike("^[A-Z]"), by_letter).when(label != "", level).otherwise(plain)
    return auto if explicit is None else F.when(explicit > 0, explicit).otherwise(auto)


def _letters(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}]", "")


def is_page_number(text: Column) -> Column:
    return text.rlike(r"(?i)^(page\s+)?\d{1,4}\z")


def stable_id(prefix: str, *parts: Column, sep: int = 31) -> Column:
    """prefix-<24 hex>; nulls count as the text None."""
    joined = F.concat_ws(chr(sep), *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, 24))


def json_fence(text: Column) -> Column:
    """Text between the first brace and the last, code fences removed."""
    x = F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```\z", "")
    inner = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.nullif(inner, F.lit(""))


def first_object(text: Column) -> Column:
    """The first JSON object that decodes anywhere in a text, thinking tags aside;
    null if none does.  From each opening brace on, a fold over the signs keeps the
    depth of braces and whether it stands inside a string, and ends where the depth
    is back at zero; what it spans is a candidate, and the first one that parses is
    taken."""
    bare = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    signs = F.split(bare, "")
    state = F.struct(F.lit(0).alias("deep"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"))

    def step(s, c):
        over = (s["n"] > 0) & (s["deep"] == 0)
        plain = ~s["quoted"]
        deep = s["deep"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        quoted = F.when((c == '"') & ~s["escaped"], plain).otherwise(s["quoted"])
        then = F.struct(deep.alias("deep"), quoted.alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), (s["n"] + 1).alias("n"))
        return F.when(over, s).otherwise(then)

    def candidate(i):
        end = F.aggregate(F.slice(signs, i, F.size(signs)), state, step)
        return F.when(end["deep"] == 0, bare.substr(i, end["n"]))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(signs), F.lit(1))), lambda i: F.get(signs, i - 1) == "{")
    parsed = lambda c: F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()
    return F.get(F.filter(F.transform(starts, candidate), lambda c: c.isNotNull() & parsed(c)), 0)


def json_string(text: Column) -> Column:
    """A JSON string literal; doubled escapes of line breaks become single."""
    x = F.regexp_replace(text, r"\\\\+n", r"\\n")
    return F.regexp_replace(F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), r"\\/", "/")


def item_text(kind: Column, text: Column, level: Column, captions: Column) -> Column:
    """An item as context: headings with a mark per level, images and tables by their
    captions, equations as they are; nothing for what has none of these."""
    own = strip(F.coalesce(text, F.lit("")))
    deep = F.coalesce(level, F.lit(0))
    told = F.when(F.size(captions) > 0, F.array_join(captions, ", "))
    shown = F.when(kind == "text", F.when((own != "") & (deep > 0), F.concat(F.repeat(F.lit("#"), deep.cast("int")), F.lit(" "), own)).otherwise(own))
    shown = shown.when(kind == "image", F.concat(F.lit("[Image: "), told, F.lit("]"))).when(kind == "table", F.concat(F.lit("[Table: "), told, F.lit("]"))).when(kind == "equation", own)
    return F.coalesce(shown, F.lit(""))


def format_list(values: Column) -> Column:
    """Non-blank values in one line, ``None`` where there are none."""
    shown = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: strip(x)), lambda x: x != "")
    return F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("None")


def section_text(parts: Column) -> Column:
    """A section path in one line, ``None`` where it is empty."""
    shown = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: strip(x) != "")
    return F.when(F.size(shown) > 0, F.array_join(shown, " > ")).otherwise("None")


def safe_extension(value: Column, default: str = "bin") -> Column:
    """A file extension of one to eight letters or digits, else the default."""
    ext = F.regexp_replace(F.lower(F.coalesce(F.nullif(value, F.lit("")), F.lit(default))), r"^\.+", "")
    return F.when(ext.rlike(r"^[a-z0-9]{1,8}\z"), ext).otherwise(default)
