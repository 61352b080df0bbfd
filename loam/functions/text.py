"""Text expressions: Column in, Column out, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------
TOKEN = r"[a-z0-9]+|[一-鿿]"
CJK = r"[一-鿿]"
SENTENCE_ENDS = "。！？!?；;\n"
SENTENCE_CUT = r"(?<=[。！？!?；;\n])"
STOP_CHARS = "的是在了我你他她它们这与那和或及不也应被等也都就很更要会能可把给到从对为以于其此个其各上中下前后内外的把被让使将已并而但若若因由"
MASKS = [("idcard", r"(?U)\d{17}[\dXx]"), ("phone", r"(?U)1[3-9]\d{9}"), ("email", r"(?U)[\w.+-]+@[\w.-]+\.\w+")]
HTML_TAG = (
    r"(?i)</?(?:html|head|body|title|meta|link|script|style|div|span|p|br|hr|img|a|table|thead|tbody|tr|td|th|ul|ol|li|dl|dt|dd|h[1-6]|strong|b|i|u|em|"
    r"font|center|small|big|blockquote|pre|code|figure|figcaption|section|article|header|footer|nav|main|aside|form|input|button|label|select|option|"
    r"textarea|iframe|sup|sub|strike|del|ins|caption|colgroup|col)\b[^>]{0,200}>"
)
#: HTML to text, in order: what goes, and what stands in its place.
HTML_STEPS = [
    (r"(?is)<(script|style|noscript|svg).*?</\1>", " "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(p|div|li|h[1-6]|tr)>", "\n"),
    (r"<[^>]+>", " "),
    (r"[ \t\u00a0]+", " "),
    (r"\n{3,}", "\n\n"),
]
#: HTML to paragraphs, before and after entities are decoded; the last step's paragraphs are lines of their own.
PARAGRAPH_STEPS = [
    (r"(?is)<(script|style|noscript|svg)[^>]*>.*?</\1>", " "),
    (r"(?is)<br\s*/?>", "\n"),
    (r"(?is)</(p|div|li|h[1-6])>", "\n"),
    (r"(?is)<[^>]+>", " "),
]
TIGHTEN_STEPS = [(r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]
LEADING_MARKS = r"(?m)^[\-—=·•\s]+"
SOURCE_CITE = r"\[来源[:：]\s*([^\]\[#]+)"
BRACKETED = r"[（(][^）)]*[)）]"
NOISE_LINE = r"(?iU)^\s*(页眉|页脚|水印|保密|机密|confidential|draft|第\s*\d+\s*页|copyright).*$"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
#: What a spoken text loses or changes, in order; $1 is what the first group held.
SPEECH = [
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"(?m)^\s*>\s*", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"),
    ("`", ""),
    (r"\|", "，"),
    ("[ \t]+", " "),
    ("\n{2,}", "\n"),
]
NARRATION_HEADING = r"(?m)^\s{0,3}#{1,6}\s*(?:第\s*|Page\s*|PAGE\s*|Slide\s*|SLIDE\s*)?(\d{1,4})\s*(?:页|张)?\b[^\n]*$"
NARRATION_RULE = r"(?m)^\s*(?:-{3,}|\*{3,}|_{3,})\s*$"
NARRATION_PAGE = r"第\s*(\d{1,4})\s*页"
EXTENSIONS = [".txt", ".md", ".docx", ".pptx", ".pdf", ".xlsx", ".xlsm", ".csv", ".html", ".htm", ".json", ".epub", ".jpg", ".jpeg", ".png", ".bmp", ".webp", ".gif"]
ENTITY_CN = (
    "[一-龥]{2,8}(?:平台|系统|一张图|数字孪生|孪生|一张图|感知|网关|边缘|算法|模型|库|闸|坝|渠|泵站|涵洞|堤防|水库|清淤|疏浚|灌区|水文|水质|水量|调度|预警|"
    "稽核|监管|台账|档案|规范|标准|条例|办法|方案|工程|项目|设备|终端|传感|采集|传输|中枢|底座|中台)"
)
ENTITY_ABBREVIATION = r"(?<![A-Za-z])([A-Z][A-Z0-9\-]{1,7})(?![A-Za-z])"
PHRASE_FRAGMENT = (
    "^(?:以下|以上|上|下|前|后|内|外|中|各|每|本|该|此|多|几|两|三|四|五|六|七|八|九|十|数|若干|所有|全部|其|之)[一二三四五六七八九十两数]*"
    "(?:台|个|张|条|项|处|块|套|次|年|月|日|类|种|路|栋|座|道)?$"
)
# ----------------------------------------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(_c(col), r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")


def blank_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(""))


def tokens(col) -> Column:
    """Lower-case ASCII words and numbers, and single CJK characters; everything else separates."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN), F.lit(0))


def content_tokens(col) -> Column:
    """Distinct tokens without the stop characters."""
    return F.array_except(F.array_distinct(tokens(col)), F.array(*[F.lit(c) for c in dict.fromkeys(STOP_CHARS)]))


def cjk_count(col) -> Column:
    return F.char_length(_c(col)) - F.char_length(F.regexp_replace(_c(col), CJK, ""))


def est_tokens(col) -> Column:
    """CJK characters plus 1.3 for each ASCII word."""
    return F.floor(cjk_count(col) + F.size(F.regexp_extract_all(_c(col), F.lit("[a-zA-Z0-9]+"), F.lit(0))) * F.lit(1.3)).cast("long")


def trace_tokens(col) -> Column:
    """CJK characters / 1.6 plus the others / 4, plus one; 0 for an empty text."""
    zh = cjk_count(col)
    return F.when(F.char_length(_c(col)) == 0, 0).otherwise(F.floor(zh / 1.6 + (F.char_length(_c(col)) - zh) / 4) + 1).cast("long")


def embed_text(text, breadcrumb) -> Column:
    """What is embedded and tokenised for search: the breadcrumb, an empty line, the text; or the text alone."""
    bc = strip(F.coalesce(_c(breadcrumb), F.lit("")))
    body = strip(F.coalesce(_c(text), F.lit("")))
    return F.when(bc == "", body).otherwise(F.concat(bc, F.lit("\n\n"), body))


def fingerprints(text) -> dict[str, Column]:
    t = _c(text)
    return {
        "fp_answer": F.md5(F.substring(t, 1, 400).cast("binary")),
        "fp_graph": F.substring(F.sha1(F.substring(t, 1, 160).cast("binary")), 1, 12),
        "fp_carry": F.substring(F.sha1(t.cast("binary")), 1, 16),
        "fp_file": F.sha2(t.cast("binary"), 256),
    }


def detect_langs(col) -> Column:
    """zh, en or both, by counting in the first 4096 characters."""
    s = F.substring(_c(col), 1, 4096)
    zh, latin = cjk_count(s), F.char_length(s) - F.char_length(F.regexp_replace(s, "[A-Za-z]", ""))
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    return F.when((s == "") | (zh > 2 * latin), arr("zh")).when(latin > 2 * zh, arr("en")).otherwise(arr("en", "zh"))


def ui_lang(col) -> Column:
    letters = F.char_length(_c(col)) - F.char_length(F.regexp_replace(_c(col), "[A-Za-z]", ""))
    return F.when((letters > cjk_count(col)) & (letters > 3), "英文").otherwise("中文")


def sentences(col) -> Column:
    """Cut after sentence ends and line breaks; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_c(col), SENTENCE_CUT), strip), lambda s: s != "")


def mask_pii(col) -> Column:
    out = _c(col)
    for label, pattern in MASKS:
        out = F.regexp_replace(out, pattern, f"[{label}已脱敏]")
    return out


def drop_noise_lines(col) -> Column:
    lines = F.split(_c(col), LINE_BREAK)
    return F.array_join(F.filter(lines, lambda x: ~F.rlike(x, F.lit(NOISE_LINE))), "\n")


def squeeze(col) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(_c(col), "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_text(col, mask: bool = True) -> Column:
    """Masks, strips known HTML tags, drops noise lines, squeezes white space."""
    out = mask_pii(col) if mask else _c(col)
    return squeeze(drop_noise_lines(F.regexp_replace(out, HTML_TAG, "")))


def stepwise(col, steps: list[tuple[str, str]]) -> Column:
    """The patterns of steps replaced one after the other."""
    out = _c(col)
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return out


def html_to_text(col) -> Column:
    return strip(stepwise(col, HTML_STEPS))


def unescape_basic(col) -> Column:
    """The five XML entities, nbsp and ASCII numeric ones stay in the JVM; &amp; comes last."""
    out = _c(col)
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.regexp_replace(out, f"&{name};", ch)
    return out


def tighten(col) -> Column:
    return strip(F.regexp_replace(strip(stepwise(col, TIGHTEN_STEPS)), LEADING_MARKS, ""))


def html_to_markdown(col) -> Column:
    """Tags to line breaks and blanks, entities decoded, one paragraph a line."""
    lines = F.transform(F.split(unescape_basic(stepwise(col, PARAGRAPH_STEPS)), "\n"), strip)
    return tighten(F.array_join(F.filter(lines, lambda x: x != ""), "\n\n"))


def clean_speech(col) -> Column:
    """Markdown marks out of a text that is to be spoken."""
    t = _c(col)
    for pattern, put in SPEECH:
        t = F.regexp_replace(t, pattern, put)
    return strip(t)


def normalize_title(name, category=None) -> Column:
    base = strip(F.translate(F.regexp_replace(_c(name), r"(?<=[^.])\.[^.]*$", ""), "_-", "  "))
    return base if category is None else F.when(_c(category) == "", base).otherwise(F.concat(F.lit("【"), _c(category), F.lit("】"), base))


def slugify(col) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(strip(col), r"(?U)[^\w\-]+", "_"), "^_+|_+$", ""))


def safe_file_name(col) -> Column:
    return F.substring(strip(F.regexp_replace(_c(col), r'[\\/:*?"<>|\s]+', "_")), 1, 60)


def media_basename(url) -> Column:
    """Last path part without query or fragment."""
    return F.element_at(F.split(F.regexp_replace(_c(url), "[?#].*$", ""), "/"), -1)


def audio_name(url) -> Column:
    return F.regexp_replace(media_basename(url), r"(?i)\.wav$", ".mp3")


def extension(name) -> Column:
    return F.lower(F.regexp_extract(_c(name), r"[^/.](\.[A-Za-z0-9]+)$", 1))


def section_title(section) -> Column:
    """A section's heading without its number and what stands in brackets."""
    return strip(F.element_at(F.split(F.regexp_replace(_c(section), BRACKETED, ""), "、"), -1))


def version_key(name) -> Column:
    """The first three numbers of a version, to be ordered by; [0] where there are none."""
    found = F.transform(F.slice(F.regexp_extract_all(F.coalesce(_c(name), F.lit("")), F.lit(r"\d+"), F.lit(0)), 1, 3), lambda x: x.try_cast("decimal(38,0)"))
    return F.when(F.size(found) == 0, F.array(F.lit(0).cast("decimal(38,0)"))).otherwise(found)


def source_cites(body) -> Column:
    """The sources that a body cites, in order, repeats included; none for a null body."""
    return F.transform(F.regexp_extract_all(F.coalesce(_c(body), F.lit("")), F.lit(SOURCE_CITE), F.lit(1)), strip)


def spare(df, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def wiki_links(body) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(_c(body), F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), strip), lambda x: x != ""))


def entities(text, breadcrumb=None, terms: tuple[str, ...] = ()) -> Column:
    """Breadcrumb parts, typed CJK terms, abbreviations and dictionary terms; distinct, sorted."""
    t = F.coalesce(_c(text), F.lit(""))
    crumbs = F.filter(F.transform(F.split(F.coalesce(_c(breadcrumb), F.lit("")) if breadcrumb is not None else F.lit(""), "[>·/|、]+"), strip), lambda x: F.char_length(x).between(2, 12))
    typed = F.filter(F.regexp_extract_all(t, F.lit(ENTITY_CN), F.lit(0)), lambda x: F.char_length(x).between(2, 12) & ~F.rlike(x, F.lit(PHRASE_FRAGMENT)))
    short = F.regexp_extract_all(t, F.lit(ENTITY_ABBREVIATION), F.lit(1))
    known = F.filter(F.array(*[F.lit(x) for x in terms]).cast("array<string>"), lambda x: F.contains(t, x))
    return F.array_sort(F.array_distinct(F.concat(crumbs, typed, short, known)))


def hit_label(page, title, source, name, breadcrumb=None) -> Column:
    """Where a hit comes from: a slide's page and title, else its source or name."""
    plain = F.when(_c(page).isNotNull(), strip(F.concat(F.lit("PPT第"), _c(page).cast("string"), F.lit("页 "), F.coalesce(_c(title), F.lit(""))))).otherwise(F.coalesce(blank_to_null(source), blank_to_null(name), F.lit("知识库")))
    if breadcrumb is None:
        return plain
    bc = F.coalesce(_c(breadcrumb), F.lit(""))
    return F.when(bc == "", plain).otherwise(F.concat(bc, F.lit(" · "), plain))
