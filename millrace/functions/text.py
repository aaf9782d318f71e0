"""Cleaners, masks and text measures as Column functions. Null stays null unless said otherwise; empty text stays empty."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Cleaner = Callable[[Column], Column]


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def steps(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: sub(x, *r), rules, c)


def strip(c: Column) -> Column:
    return sub(c, r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$")


def char_grams(c: Column, k: int) -> Column:
    """All runs of k characters in order, none for shorter texts. Runs are put together from halves, so the work grows with the text's length alone."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    out, have, part, wide = None, 0, chars, 1
    while wide <= k:
        if k & wide:
            out = part if out is None else F.zip_with(out, F.slice(part, have + 1, F.size(chars) + 1), lambda a, b: F.concat(a, b))
            have += wide
        if 2 * wide <= k:
            part = F.zip_with(part, F.slice(part, wide + 1, F.size(chars) + 1), lambda a, b: F.concat(a, b))
        wide *= 2
    return F.array_compact(out)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def whitespace(c: Column) -> Column:
    lines = F.split(sub(sub(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"), "\n", -1)
    return strip(join_lines(F.transform(lines, strip)))


#: Characters that survive the special-character pass beside letters, digits, blanks; fixed values.
KEPT = r'_\s"\-ãï¼â¦Â·'


def special_chars(c: Column) -> Column:
    return sub(sub(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), rf"[^\p{{L}}\p{{N}}{KEPT}]")


def entities(c: Column) -> Column:
    return sub(sub(c, "&nbsp;", " "), r"&[a-zA-Z]+;|&#[0-9]+;")


def html_tags(c: Column) -> Column:
    """The greedy variant: everything from the first script or style to the last end of one goes."""
    no_blocks = sub(sub(c, r"(?is)<script[^>]*>.*</script>"), r"(?is)<style[^>]*>.*</style>")
    return entities(sub(no_blocks, r"<[^>]+>", " "))


#: What each rule-based cleaner replaces, in order.
MARKDOWN = [
    (r"(?m)^#{1,6}\s+", ""), (r"\*{1,2}([^*]+)\*{1,2}", "$1"), (r"_{1,2}([^_]+)_{1,2}", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "[å¾ç: $1]"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^[-*+]\s+", ""), (r"(?m)^[0-9]+\.\s+", ""), (r'`{1,3}([^`]+")`{1,3}', "$1"), (r"(?m)^>+\s*", ""), (r"(?m)^-{3,}$", ""), (r"(?m)^\*{3,}$", ""),
]
PRIVACY = [
    (r"1[3-9][0-9]{9}", "[PHONE]"), (r"[0-9]{3,4}-[0-9]{7,8}", "[PHONE]"), (r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", "[EMAIL]"),
    (r"[0-9]{17}[0-9Xx]", "[ID_CARD]"), (r"[0-9]{15}", "[ID_CARD]"), (r"[0-9]{16,19}", "[BANK_CARD]"),
]
LEGAL = [
    (r"（[0-9]{4}）\s*", ""), (r"(\S)(第[一二三四五六七八九十百千零0-9]+条)", "$1\n$2"), (r"(\S)(第[一二三四五六七八九十百千零0-9]+章)", "$1\n\n$2"),
    (r"[（(]\s*([一二三四五六七八九十百千]+)\s*[)）]", "第$1条"), (r"签订地点[^\n]*", ""), (r"签订日期[^\n]*", ""),
]
TECHNICAL = [
    (r"```[a-z]*\n", "\n[代码块开始]\n"), (r"```", "\n[代码块结束]\n"), (r"`([^`]+)`", "代码:$1"), (r"!\[([^\]]*)\]\([^)]+\)", "[图示:$1]"), (r"[A-Z_]{3,}", "[常量:$0]"), (r"(?i)version:\s*[0-9.]+", ""),
]
MEDICAL = [
    (r"门诊号[：:]\s*[A-Z0-9]+", "[门诊号]"), (r"病历号[：:]\s*[A-Z0-9]+", "[病历号]"), (r"床号[：:]\s*[A-Z0-9]+", "[床号]"), (r"患者[姓名]*[：:]\s*[^\s：:]+", "患者[姓名已脱敏]"),
    (r"年龄[：:]\s*[0-9]+岁", "[年龄]"), (r"[0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2}日", "[日期]"),
]
FINANCIAL = [
    (r"账号[：:]\s*[0-9A-Z]+", "[账号]"), (r"账户号[：:]\s*[0-9A-Z]+", "[账户号]"), (r"交易[流水号]*[：:]\s*[A-Z0-9]+", "[交易号]"), (r"¥\s*[0-9,]+\.[0-9]*", "[金额]"), (r"人民币\s*[0-9,]+\.[0-9]*\s*元", "[金额]"),
    (r"身份证[：:]\s*[0-9]{17}[0-9Xx]", "[身份证]"),
]
ACADEMIC = [
    (r"\[[0-9]+\]", "[引用]"), (r"\([A-Z][^)]+,\s*[0-9]{4}[a-z]\)", "[引用]"), (r"关键词[：:]\s*", "\n关键词 "), (r"摘要[：:]\s*", "\n摘要: "), (r"(?i)DOI[：:]\s*\S+", "[DOI]"), (r"通讯作者[：:][^\n]+", ""),
]
NEWS = [
    (r"记者[：:]\s*\S+", ""), (r"编辑[：:]\s*\S+", ""), (r"来源[：:]\s*\S+", ""), (r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日\s*[0-9]{1,2}:[0-9]{2}", "[发布时间]"), (r"（[^）]+）", ""),
    (r"相关阅读[：:][^\n]*", ""), (r"推荐阅读[：:][^\n]*", ""),
]
#: Threat patterns (any case), then invisible characters.
THREATS = [
    r"ignore\s+(previous|all|above)\s+instructions?", r"you\s+are\s+now\s+", r"system\s*:\s*", r"<\|im_start\|>", r"###\s*Instruction", r"pretend\s+you\s+are", r"jailbreak", r"inject\s+prompt",
    r"override\s+system", r"new\s+rules?\s*:", r"forget\s+(everything|all|previous)", r"act\s+as\s+if",
]
INVISIBLE = r"[\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}]"


def markdown(c: Column) -> Column:
    return steps(c, MARKDOWN)


def privacy(c: Column, ip: bool = False) -> Column:
    """In this order, so that earlier masks take digits from later ones."""
    return steps(c, PRIVACY + [(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]")] * ip)


def duplicate_lines(c: Column, least: int = 10, quoted: bool = True) -> Column:
    """Lines of under `least` stripped characters stay; of others the first of each key (blanks collapsed, lower case). quoted: a quoted end of 20
    characters or more that follows itself within a line stays once."""
    lines = F.split(c, "\n", -1)
    keyed = F.transform(lines, lambda x, i: F.struct(F.lower(sub(strip(x), r"[ \t\r\f\x0b]+", " ")).alias("k"), i.alias("i"), (F.length(strip(x)) >= least).alias("long"), x.alias("line")))
    # sorted by key and place, a line is a repeat if the one before it has its key; then back to the lines' order
    ordered = F.array_sort(F.filter(keyed, lambda x: x["long"]))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda x: x["k"]))
    first = F.filter(F.zip_with(ordered, F.slice(before, 1, F.size(ordered)), lambda x, b: F.struct(x["i"].alias("i"), x["line"].alias("line"), x["k"].eqNullSafe(b).alias("twin"))), lambda x: ~x["twin"])
    short = F.transform(F.filter(keyed, lambda x: ~x["long"]), lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), F.lit(False).alias("twin")))
    kept = join_lines(F.transform(F.array_sort(F.concat(first, short)), lambda x: x["line"]))
    # two marks at least, so texts with fewer are not searched: the search takes quadratic time in a line's length
    return F.when(F.length(kept) - F.length(F.replace(kept, F.lit('"'), F.lit(""))) < 2, kept).otherwise(sub(kept, r'(.{20,}")\1+', "$1")) if quoted else kept


def noise(c: Column) -> Column:
    return strip(steps(c, [(r"Copyright[^\n]*", ""), (r"All Rights Reserved\.?", ""), (r"(?i)\[advertisement\]", ""), (r"\n{3,}", "\n\n")]))


#: Full-width marks and what they become; entities, tags and masks below are fixed values too.
WIDE, NARROW = "，。：；！（）“”‘’", ",.:;!()\"\"''"


def encoding(c: Column) -> Column:
    return sub(F.translate(c, WIDE, NARROW), r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")


def length_filter(c: Column, least: int = 10, meaningful: int = 5) -> Column:
    """Lines with too few characters, or too few beside blanks, dashes, dots and commas, go."""
    return join_lines(F.filter(F.split(c, "\n", -1), lambda x: (F.length(strip(x)) >= least) & (F.length(sub(strip(x), r"[\s\-.,ï¼ã]+")) >= meaningful)))


def ocr_noise(c: Column) -> Column:
    return strip(steps(c, [(r"[\x{FEFF}\x{FFFD}]", ""), (r"-\s*\n\s*", ""), (r"[|\x{2500}-\x{257F}]+", " "), (r"\.{2,}", "."), (r"\s{2,}", " ")]))


def ocr_confidence(c: Column) -> Column:
    """1 - min(0.8, share of invalid characters + 0.05 per run of five equal ones), 3 digits; empty: 0."""
    n = F.length(c)
    bad = F.length(sub(c, r"[A-Za-z0-9\x{4e00}-\x{9fff}\s.,!;:'\"\-()\[\]{}\\/]"))
    runs = F.regexp_count(c, F.lit(r"([^\n])\1{4,}"))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(1 - F.least(F.lit(0.8), bad / n + 0.05 * runs), 3))


def language(c: Column) -> Column:
    return F.when(c.rlike("[一-鿿]"), F.lit("zh")).when(c.rlike("[A-Za-z]"), F.lit("en")).otherwise(F.lit("und"))


def run_tokens(c: Column) -> Column:
    """CJK runs and ASCII letter-digit runs, case kept."""
    return F.regexp_extract_all(c, F.lit(r"[一-鿿]+|[A-Za-z0-9]+"), F.lit(0))


def search_tokens(c: Column) -> Column:
    """Single CJK characters and ASCII words, lower-cased: what the BM25 index holds."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[a-zA-Z0-9_]+|[一-鿿]"), F.lit(0)), F.lower)


def sentences(c: Column) -> Column:
    guarded = sub(c, r"([0-9])\.([0-9])", "$1\x01$2")
    cut = F.when(c.rlike("[一-鿿]"), F.split(guarded, "(?<=[。！？；])")).otherwise(F.split(guarded, r"(?<=[.!?;])\s+"))
    return F.filter(F.transform(cut, lambda x: strip(F.translate(x, "\x01", "."))), lambda x: x != "")


def match_text(c: Column) -> Column:
    return sub(c, r"[\s，。：；！？、（）“”‘’《》【】,.:;!?()\[\]{}\"'`~\-]+")


def think_blocks(c: Column) -> Column:
    return strip(sub(c, r"(?is)<think>.*?</think>"))


def embedding_text(c: Column, max_tokens: int = 512, instruction: str = "") -> Column:
    limit = max(32, (max_tokens - 1) * 2)
    body = F.concat(F.lit(instruction), strip(c))
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("..."))).otherwise(body)


def partial_masks(c: Column) -> Column:
    """Keeps the ends: phone 3****4, mail x***@domain, id 6********4, bank 4****4."""
    return steps(c, [(r"(1[3-9][0-9])[0-9]{4}([0-9]{4})", "$1****$2"), (r"([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2"), (r"([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])", "$1********$2"), (r"([0-9]{4})[0-9]{8,11}([0-9]{4})", "$1****$2")])


def sensitivity(c: Column) -> Column:
    pii = r"1[3-9][0-9]{9}|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
    return F.when(c.rlike(r"[0-9]{17}[0-9Xx]|[0-9]{16,19}"), F.lit("secret")).when(c.rlike(pii), F.lit("pii")).otherwise(F.lit("public"))


def cache_ttl(c: Column, default: int = 900) -> Column:
    kind = sensitivity(c)
    return F.when(kind == "secret", F.lit(0)).when(kind == "pii", F.lit(default // 3)).otherwise(F.lit(default))


def threat(c: Column) -> Column:
    """The first reason that matches, or null."""
    found = [F.when(c.rlike("(?i)" + p), F.lit(f"Threat pattern matched: {p}")) for p in THREATS]
    digits = F.hex(F.ascii(F.regexp_extract(c, f"({INVISIBLE})", 1)))
    point = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    return F.coalesce(*found, F.when(c.rlike(INVISIBLE), F.concat(F.lit("Invisible Unicode U+"), point, F.lit(" detected"))))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) * 0.7).cast("long")


def audit_hash(c: Column) -> Column:
    return F.concat(F.substring(F.sha2(c, 256), 1, 16), F.lit(":"), F.length(c).cast("string"))


def legal(c: Column) -> Column:
    return strip(steps(c, LEGAL))


def technical(c: Column) -> Column:
    return strip(steps(c, TECHNICAL))


def medical(c: Column) -> Column:
    return strip(steps(c, MEDICAL))


def financial(c: Column) -> Column:
    return strip(steps(c, FINANCIAL))


def academic(c: Column) -> Column:
    return strip(steps(c, ACADEMIC))


def news(c: Column) -> Column:
    return strip(steps(c, NEWS))


CLEANERS: dict[str, Cleaner] = {
    "whitespace": whitespace, "special_char": special_chars, "html": html_tags, "markdown": markdown, "privacy": privacy, "duplicate": duplicate_lines, "noise": noise,
    "encoding": encoding, "length": length_filter, "ocr": ocr_noise, "legal": legal, "technical": technical, "medical": medical, "financial": financial, "academic": academic, "news": news,
}

CHAINS: dict[str, list[str]] = {
    "default": ["encoding", "html", "special_char", "whitespace", "privacy", "noise"],
    "legal": ["encoding", "legal", "whitespace"],
    "technical": ["markdown", "technical", "whitespace"],
    "medical": ["encoding", "medical", "privacy", "whitespace"],
    "financial": ["encoding", "financial", "privacy", "whitespace"],
    "academic": ["academic", "whitespace"],
    "news": ["html", "news", "duplicate", "whitespace"],
    "ocr": ["ocr", "whitespace", "length"],
}


def register_cleaner(name: str, cleaner: Cleaner) -> None:
    CLEANERS[name] = cleaner


def chain(c: Column, names: list[str]) -> Column:
    """Cleaners in turn; unknown names are skipped."""
    return reduce(lambda x, n: CLEANERS[n](x), [n for n in names if n in CLEANERS], c)


def by_type(c: Column, doc_type: Column) -> Column:
    out = None
    for t, names in CHAINS.items():
        if t != "default":
            out = F.when(doc_type == t, chain(c, names)) if out is None else out.when(doc_type == t, chain(c, names))
    return out.otherwise(chain(c, CHAINS["default"]))
