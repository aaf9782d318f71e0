"""Record, table, OCR and answer text as Column functions. Only what Spark has no function for (NFKC, HTML parsing, CSV quoting) runs in
Arrow-batched Python. Null gives the empty result named in each docstring; empty text stays empty."""

from __future__ import annotations

import csv
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions.text import language, ocr_noise, run_tokens, steps, strip, sub


#: Texts that nfkc() turns and sends back at once; a whole Arrow batch may hold 10,000.
TEXTS = 256


@F.arrow_udf(StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode NFKC; null stays null."""
    for b in batches:
        for at in range(0, len(b), TEXTS):
            yield pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in b.slice(at, TEXTS).to_pylist()], pa.string())


def clean_text(c: Column) -> Column:
    """Control characters to a blank, NFKC, blanks collapsed and stripped; null gives an empty text. Only texts beyond ASCII go to Python."""
    text = sub(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]+", " ")
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return strip(sub(F.when(plain, text).otherwise(nfkc(F.when(~plain, text))), r"(?U)\s+", " "))


class _Text(HTMLParser):
    """Text outside of the parts that are no content."""

    SKIP = {"script", "style", "nav", "footer", "header"}

    def __init__(self, links: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth, self.links, self.href = 0, links, None

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        if tag == "a":
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.depth:
            self.depth -= 1
        if tag == "a" and self.links and self.href and self.out:
            self.out[-1] += f" ({self.href})"
        self.href = None if tag == "a" else self.href

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.out.append(data.strip())


def html_text(c: Column, links: bool = False) -> Column:
    """Text of an HTML page without scripts, styles, navigation, header and footer; pieces are joined by a blank."""

    @F.pandas_udf(StringType())
    def parsed(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            p = _Text(links)
            p.feed(x)
            p.close()
            return " ".join(p.out)

        return s.map(one)

    return parsed(c)


# ---- OCR text ----


def lines_of(c: Column) -> Column:
    return F.split(sub(c, r"\r\n?", "\n"), "\n", -1)


def merged_lines(c: Column) -> Column:
    """Lines stripped; a line joins the one before it unless that ends a sentence or the line begins with A-Z or a CJK character."""
    lines = F.filter(F.transform(lines_of(c), strip), lambda x: x != "")
    empty = F.expr("cast(array() as array<string>)")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        new = (F.size(a) == 0) | last.rlike(r"[.。！？!?]$") | x.rlike("^[A-Z一-鿿]")
        return F.when(new, F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last, F.lit(" "), x))))

    return F.array_join(F.aggregate(lines, empty, step), "\n")


def table_like(c: Column) -> Column:
    """At least two line breaks, and a pipe or tab, or two blanks in a row on half of the lines."""
    full = F.filter(lines_of(c), lambda x: x.rlike(r"\S"))
    wide = F.size(F.filter(full, lambda x: x.rlike(r"\s{2,}")))
    breaks = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.coalesce((breaks >= 2) & (c.rlike(r"[|\t]") | ((F.size(full) >= 2) & (wide >= F.greatest(F.lit(1), F.floor(F.size(full) / 2))))), F.lit(False))


def table_text(c: Column) -> Column:
    """Full lines, blanks collapsed."""
    return F.array_join(F.filter(F.transform(lines_of(c), lambda x: strip(sub(x, r"\s+", " "))), lambda x: x != ""), "\n")


def postprocess_ocr(c: Column, layout: bool = False, tables: bool = True) -> Column:
    """Table-like text line by line (noise collapses it first, as it takes the line breaks of blank runs), else merged lines if the layout
    counts, else one line. Null gives an empty text."""
    text = F.coalesce(c, F.lit(""))
    quiet = ocr_noise(text)
    other = clean_text(merged_lines(quiet)) if not layout else merged_lines(quiet)
    flat = clean_text(F.replace(quiet, F.lit("\n"), F.lit(" ")))
    return F.when(table_like(text) if tables else F.lit(False), table_text(quiet)).otherwise(other if layout else flat)


# ---- tables in texts: rows as array<array<string>> ----


def markdown_rows(c: Column) -> Column:
    """Cells of the lines with a pipe, without separator rows."""
    lines = F.filter(F.transform(lines_of(c), strip), lambda x: x.contains("|") & ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(sub(x, r"^\|+|\|+$"), r"\s*\|\s*", -1), strip))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once. What a lambda uses from outside as an expression is worked out for each element anew."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_rows(c: Column) -> Column:
    """A list of objects: the union of the keys in order of first appearance, then a row for each object; missing and null cells are empty.
    An empty array for anything else."""

    def rows(items: Column) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(items, F.map_keys)))
        return let(keys, lambda ks: F.concat(F.array(ks), F.transform(items, lambda m: F.transform(ks, lambda k: F.coalesce(F.element_at(m, k), F.lit(""))))))

    none = F.expr("cast(array() as array<array<string>>)")
    return let(F.from_json(c, "array<map<string,string>>"), lambda items: F.when(F.size(items) > 0, rows(items)).otherwise(none))


ROWS = ArrayType(ArrayType(StringType()))


def csv_rows(c: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """Rows that are not blank."""

    @F.pandas_udf(ROWS)
    def parsed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [r for r in csv.reader((x or "").strip().splitlines(), delimiter=delimiter, quotechar=quote) if any(v.strip() for v in r)])

    return parsed(c)


class _Cells(HTMLParser):
    """Rows of the first table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.inside, self.over = False, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.inside = not self.over
        elif self.inside and tag == "tr":
            self.rows.append([])
        elif self.inside and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.inside:
            self.inside, self.over = False, True
        elif tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_rows(c: Column) -> Column:
    """Cells of the first table; rows without cells are left out."""

    @F.pandas_udf(ROWS)
    def parsed(s: pd.Series) -> pd.Series:
        def one(x):
            p = _Cells()
            p.feed(x or "")
            p.close()
            return [r for r in p.rows if r]

        return s.map(one)

    return parsed(c)


def rows_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, strip), " | ")), "\n")


def table_extract(c: Column, delimiter: str = ",") -> Column:
    """The table in a text as lines of cells joined by " | ": JSON, HTML, Markdown, else CSV; text without a table as it is, stripped."""
    text = strip(F.coalesce(c, F.lit("")))
    found = (
        F.when(text.rlike(r"^\[\s*\{"), json_rows(text))
        .when(text.rlike(r"(?i)<table"), html_rows(text))
        .when(text.contains("|") & text.contains("\n"), markdown_rows(text))
        .when(text.contains(delimiter) & text.contains("\n"), csv_rows(text, delimiter))
    )
    return F.when(F.size(found) > 0, rows_text(found)).otherwise(text)


# ---- metadata ----

#: Names of metadata keys and what they are called here.
ALIASES = {
    "author": ["author", "作者", "writer", "written_by", "creator"],
    "title": ["title", "标题", "name"],
    "source": ["source", "来源", "origin"],
    "source_id": ["source_id", "sourceid", "source-id", "id", "doc_id", "document_id"],
    "created_at": ["created_at", "created", "creation_date", "date", "date_created", "创建时间"],
    "updated_at": ["updated_at", "updated", "modified", "modified_at", "date_modified", "更新时间"],
    "tags": ["tags", "tag", "keywords", "keyword", "labels", "标签"],
    "summary": ["summary", "description", "desc", "摘要"],
}


def metadata_key(c: Column) -> Column:
    key = sub(F.translate(F.lower(strip(c)), " -", "__"), r"[^\p{L}\p{N}_]")
    names = F.create_map(*[F.lit(x) for to, known in ALIASES.items() for k in known for x in (k, to)])
    return let(key, lambda k: F.coalesce(names[k], k))


def iso_date(c: Column) -> Column:
    """The first y-m-d (also with . and /) as ISO time at midnight; other text as it is."""
    part = lambda i: F.regexp_extract(c, r"([0-9]{4})[./-]([0-9]{1,2})[./-]([0-9]{1,2})", i)
    day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), strip(c))


def tags_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,|]+"), strip), lambda x: x != "")


def metadata(m: Column) -> Column:
    """A map<string,string> with canonical keys: dates ISO, tags trimmed and joined by commas, other values cleaned of blanks. Null values
    and empty keys go; of keys that become equal the last stays."""
    named = F.transform(F.filter(F.map_entries(m), lambda e: e["value"].isNotNull()), lambda e: F.struct(metadata_key(e["key"]).alias("key"), e["value"].alias("value")))

    def value(e: Column) -> Column:
        k = e["key"]
        plain = strip(sub(sub(e["value"], r"[\x00-\x1f\x7f]+", " "), r"\s+", " "))
        return F.when(k.isin("created_at", "updated_at"), iso_date(e["value"])).when(k == "tags", F.array_join(tags_of(e["value"]), ",")).otherwise(plain)

    def last(new: Column) -> Column:
        return F.filter(new, lambda e, i: ~F.exists(F.slice(new, i + 2, F.size(new)), lambda o: o["key"] == e["key"]))

    kept = let(F.filter(named, lambda e: e["key"] != ""), last)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))))


def store_metadata(m: Column) -> Column:
    """What a vector store takes: nulls dropped, tags also under tags_csv."""
    kept = F.map_filter(m, lambda k, v: v.isNotNull())
    tags = F.element_at(kept, "tags")
    return F.when(tags.isNotNull(), F.map_concat(F.map_filter(kept, lambda k, v: k != "tags_csv"), F.create_map(F.lit("tags_csv"), tags))).otherwise(kept)


def cleaned_record(text: Column) -> list[Column]:
    """chunk_text, lang, tokens, token_count of a record's text."""
    clean = clean_text(text)
    tokens = run_tokens(clean)
    return [clean.alias("chunk_text"), language(clean).alias("lang"), tokens.alias("tokens"), F.size(tokens).cast("long").alias("token_count")]


# ---- answers and prompts ----


def json_in_text(c: Column) -> Column:
    """The JSON of a text, as text: the whole, the first fenced block, else from the first brace to the last; null without any."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.when(F.call_function("try_parse_json", x).isNotNull() & (x != ""), x)
    return F.coalesce(valid(c), valid(fenced), valid(braces))


def summary(fragments: Column, most: int = 2000) -> Column:
    """Fragments joined by an empty line; over `most` characters cut, back to a line break past 70 %, and marked."""
    joined = F.array_join(fragments, "\n\n")
    cut = F.substring(joined, 1, most)
    at = most - F.locate("\n", F.reverse(cut))
    back = F.when(F.reverse(cut).contains("\n") & (at > most * 0.7), F.substring(cut, F.lit(1), at)).otherwise(cut)
    # a double break counts from its first character
    back = F.when(back.endswith("\n"), F.substring(back, F.lit(1), F.length(back) - 1)).otherwise(back)
    return F.when(F.size(fragments) == 0, F.lit("No relevant messages found")).when(F.length(joined) <= most, joined).otherwise(F.concat(back, F.lit("\n[... truncated ...]")))


#: Sentences in which someone says their name, and what is no name.
NAMES = ["^我叫(.+)$", "^我的名字是(.+)$", "^名字是(.+)$", "^叫([一-龥a-zA-Z]{1,12})$", "^我是([一-龥]{1,2})$"]
NO_NAMES = ["谁", "什么", "哪个", "哪位"]


def said_name(c: Column) -> Column:
    """The name in a self-introduction, or null."""
    q = sub(strip(c), r"[。！!？?~]+$")
    found = [strip(F.regexp_extract(q, p, 1)) for p in NAMES]
    return F.coalesce(*(F.when((x != "") & (F.length(x) <= 20) & ~x.isin(NO_NAMES), x) for x in found))


def allowed_fact(key: Column, allowed: list[str] | None = None) -> Column:
    """Whether a fact's key may be kept: not empty, and in the list if there is one."""
    ok = F.coalesce(strip(key) != "", F.lit(False))
    return ok & key.isin(allowed) if allowed else ok


def audit_content(c: Column, policy: str = "hash", most: int = 8000) -> Column:
    """hash: sha256 (16 digits) and length; full: the text cut to `most`; redacted: masked, then cut."""
    from millrace.functions.text import audit_hash, partial_masks

    if policy == "hash":
        return audit_hash(c)
    text = c if policy == "full" else partial_masks(c)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


#: Personal data as the audit log looks for it, in the order of the masks.
AUDIT_PII = {
    "phone": r"1[3-9][0-9]{9}|\+[0-9]{1,3}[-\s]?[0-9]{7,15}",
    "id_card": r"[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "bank_card": r"[1-9][0-9]{14,18}",
}
#: The same with groups for what stays: 3 and 4 characters of a phone, 6 and 4 of an id, 2 and the domain of a mail, 4 and 4 of a card.
AUDIT_MASKS = [
    (r"(?:(1[3-9][0-9])[0-9]{4}([0-9]{4})|(?=(\+[0-9\s-]{2}))\+[0-9]{1,3}[-\s]?[0-9]{3,11}([0-9]{4})(?![0-9]))", "$1$3****$2$4"),
    (r"([1-9][0-9]{5})(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])([0-9]{3}[0-9Xx])", "$1********$2"),
    (r"([a-zA-Z0-9._%+-]{2})[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2"),
    (r"([1-9][0-9]{3})[0-9]{7,11}([0-9]{4})", "$1**********$2"),
]


def audit_mask(c: Column) -> Column:
    return steps(c, AUDIT_MASKS)


def audit_counts(c: Column) -> Column:
    """struct of the number of finds by kind."""
    return F.struct(*(F.regexp_count(c, F.lit(p)).cast("long").alias(k) for k, p in AUDIT_PII.items()))


def redacted_messages(messages: Column, mask) -> Column:
    """array<struct<role, content>> with masked contents."""
    return F.transform(messages, lambda m: m.withField("content", mask(m["content"])))


def redacted_map(m: Column, mask) -> Column:
    return F.transform_values(m, lambda k, v: mask(v))


def without_fences(role: Column, text: Column) -> Column:
    """Thoughts go from every turn, fenced blocks from the assistant's."""
    quiet = sub(text, r"(?is)<think>.*?</think>")
    return strip(F.when(role == "assistant", sub(quiet, r"(?s)```.*?```")).otherwise(quiet))


def mock_embedding(c: Column, size: int = 64) -> Column:
    """The bytes of the text's sha256, tiled, as b / 127.5 - 1, scaled to length 1: a stand-in that needs no model."""
    digest = F.sha2(F.coalesce(c, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)
    return F.element_at(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))), 1)


#: Extensions and the format that they mean.
FORMATS = {"pdf": "pdf", "doc": "word", "docx": "word", "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tiff": "image", "tif": "image", "webp": "image", "html": "html", "htm": "html", "txt": "text", "md": "markdown", "markdown": "markdown"}


def format_of(path: Column) -> Column:
    """The format that a path's extension means; text for any other."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v)])[ext], F.lit("text"))


def search_terms(c: Column, most: int = 10) -> Column:
    """Parts of a query of two characters or more in order: between blanks and marks, ASCII words, the whole without these, and its bigrams
    if it has four characters; the query itself if there is none."""
    q = strip(c)
    marks = r"[\s,，。！？、；;]+"
    whole = sub(q, marks)
    chars = F.split(whole, "")
    pairs = F.when(F.length(whole) >= 4, F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))).otherwise(F.expr("cast(array() as array<string>)"))
    every = F.concat(F.split(q, marks), F.regexp_extract_all(q, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)), F.array(whole), pairs)
    found = F.slice(F.array_distinct(F.filter(F.transform(every, strip), lambda t: F.length(t) >= 2)), 1, most)
    return F.when(q == "", F.expr("cast(array() as array<string>)")).when(F.size(found) > 0, found).otherwise(F.array(q))


def match_normal(c: Column) -> Column:
    return sub(strip(F.coalesce(c, F.lit(""))), r"""[\s*：:，,。；;？?！!\-—、（）()【】\[\]「」"'《》·.…]""")


def contexts_match(reference: Column, retrieved: Column, overlap: int = 20) -> Column:
    """Whether two texts are the same passage: normalised they are equal, one holds the other, or they share a beginning (also without a
    leading number), or the shorter, of 16 characters and 55 % of the longer, has its first 32 in it."""
    return normals_match(match_normal(reference), match_normal(retrieved), overlap)


def normals_match(a: Column, b: Column, overlap: int = 20) -> Column:
    """contexts_match of texts that are normalised already."""

    def alike(a: Column, b: Column) -> Column:
        n = F.least(F.lit(overlap), F.length(a), F.length(b))
        head = (n >= 8) & (F.contains(b, F.substring(a, F.lit(1), n)) | F.contains(a, F.substring(b, F.lit(1), n)))
        return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | head)

    number = r"^[0-9]{1,3}\.?"
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    probe = (F.length(shorter) >= 16) & (F.length(shorter) >= 0.55 * F.length(longer)) & F.contains(longer, F.substring(shorter, 1, 32))
    return (a != "") & (b != "") & (alike(a, b) | alike(sub(a, number), sub(b, number)) | probe)
