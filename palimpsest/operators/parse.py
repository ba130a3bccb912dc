"""Raw text or bytes to clean text, by content type."""

from __future__ import annotations

import email
import html.parser
import re
from collections.abc import Callable
from email import policy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions.arrow import of_texts
from palimpsest.functions.text import collapse, strip, word_count
from palimpsest.operators.article import article_text


def _by_extension(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for kind, endings in table.items() for e in endings for x in (e, kind)))


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"[^.](\.[^.]*)$", 1)


def content_type(name: Column, text: Column) -> Column:
    """Extension, then leading characters, then plain."""
    known = F.try_element_at(_by_extension(config.CONTENT_TYPES), extension(name))
    return F.coalesce(known, F.when(F.startswith(text, F.lit("%PDF")), "pdf").when(F.startswith(text, F.lit("<")), "html").otherwise("plain"))


def language(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_by_extension(config.LANGUAGES), extension(name)), F.lit("unknown"))


def decoded(raw: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def plain(text: Column) -> Column:
    return strip(text)


def html_title(text: Column) -> Column:
    return collapse(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(text: Column) -> Column:
    """Tags as spaces, white space collapsed, title before it."""
    body = collapse(F.regexp_replace(text, r"<[^>]+>", " "))
    title = html_title(text)
    return F.when(title != "", F.concat(title, F.lit("\n\n"), body)).otherwise(body)


def html_article(text: Column) -> Column:
    """As html_text, with scripts, styles, comments and navigation removed first: the fall-back where a page has no article."""
    return html_text(F.regexp_replace(text, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>|<!--.*?-->", " "))


def pdf_clean(text: Column) -> Column:
    """Extracted text with each line collapsed and empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: x != ""), "\n")


def pdf_pages(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3000)).cast("long")


def code_symbols(text: Column, lang: Column) -> Column:
    """Python: top-level functions, then classes; else any definition keyword's name, in order."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    python = F.concat(found(r"(?m)^(?:async[ \t]+)?def[ \t]+([A-Za-z0-9_]+)"), found(r"(?m)^class[ \t]+([A-Za-z0-9_]+)"))
    return F.when(lang == "python", python).otherwise(found(r"(?:function|def|class|fn|struct|impl|interface|pub fn)[ \t\n\r]+([A-Za-z0-9_]+)"))


def code_docs(text: Column, lang: Column) -> Column:
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return F.when(lang == "python", found(r'(?s)"""(.*?)"""')).otherwise(found(r"(?s)/\*\*?(.*?)\*/"))


Finder = Callable[[Column, Column], Column]


def code_text(text: Column, lang: Column, symbols_of: Finder = code_symbols, docs_of: Finder = code_docs) -> Column:
    """Documentation, symbols and the code. The finders are column functions of text and language to array<string>, say Pandas UDFs around a syntax parser."""
    docs, symbols = docs_of(text, lang), symbols_of(text, lang)
    part = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(xs, "\n")))
    return F.concat_ws("\n\n", part("Documentation", docs), part("Symbols", symbols), text)


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _content(part) -> str:
    """Text of a part. Without a transfer encoding it is the characters as they stand."""
    if str(part.get("Content-Transfer-Encoding", "8bit")).strip().lower() in ("7bit", "8bit", "binary"):
        return part.get_payload()
    return part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace")


def _mail(raw: str) -> str:
    message = email.message_from_string(raw, policy=policy.default)
    head = [f"{k}: {message[k]}" for k in ("Subject", "From", "To", "Date") if message[k]]
    parts = [p for p in message.walk() if not p.is_multipart()]
    chosen = next((p for p in parts if p.get_content_type() == "text/plain"), None)
    if chosen is not None:
        body = _content(chosen)
    else:
        page = next((p for p in parts if p.get_content_type() == "text/html"), None)
        body = " ".join(re.sub(r"<[^>]+>", " ", _content(page)).split()) if page else ""
    return "\n".join([*head, "", body]).strip()


_email_text = of_texts(_mail)


def email_text(text: Column) -> Column:
    """Header lines, an empty line, and the text part (else the HTML part without tags)."""
    return _email_text(text)


_INLINE = (
    (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"!?\[([^\]]+)\]\[[^\]]*\]"), r"\1"),
    (re.compile(r"(\*\*|__|\*|_|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
)
_FENCE, _HEADING, _UNDERLINE = re.compile(r"\s*(`{3,}|~{3,})(.*)$"), re.compile(r"\s*#{1,6}\s+"), re.compile(r"\s{0,3}(=+|-+)\s*$")
_MARK, _TARGET = re.compile(r"\s*(#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)"), re.compile(r"\s{0,3}\[[^\]]+\]:\s+\S")
_RULER = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def _markdown(text: str) -> str:
    lines, out, fence, table = text.split("\n"), [], "", False
    skip = False
    for i, line in enumerate(lines):
        after = lines[i + 1] if i + 1 < len(lines) else ""
        mark = _FENCE.match(line)
        if mark and not fence:
            fence = mark[1]
            out.append(line.strip())
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
            fence = ""
            out.append(line.strip())
        elif fence:  # other fences inside a longer one are text
            out.append(line)
        elif skip:  # the line under a heading or the head of a table
            skip = False
        elif not line.strip() or _TARGET.match(line):
            table = False
        else:
            underlined = bool(_UNDERLINE.match(after)) and not _MARK.match(line) and "|" not in line
            if "|" in line and "|" in after and _RULER.match(after):
                table = skip = True
            elif _HEADING.match(line) or underlined:
                out.append("")
                skip = underlined
            for pattern, new in _INLINE:
                line = pattern.sub(new, line)
            line = " | ".join(x.strip() for x in line.strip().strip("|").split("|")) if table and "|" in line else _MARK.sub("", line, count=1) if _MARK.match(line) else line
            if line.strip():
                out.append(line.strip())
    return "\n".join(out).strip()


_markdown_text = of_texts(_markdown)


def markdown_text(text: Column) -> Column:
    """Inline text of blocks: an empty line before headings of either form, fences kept, table rows with bars between cells, link targets left out."""
    return _markdown_text(text)


class _Article(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "nav")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style", "nav")))
        if tag in ("p", "div", "h1", "h2", "h3", "li", "br"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def _page(text: str) -> str:
    parser = _Article()
    parser.feed(text)
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.parts).split("\n")) if x)


_html_blocks = of_texts(_page)


def html_blocks(text: Column) -> Column:
    """Text of block elements, one line each, entities resolved."""
    return _html_blocks(text)


def parsed(docs: DataFrame, path: str = "source_path", text: str = "text", symbols_of: Finder = code_symbols, docs_of: Finder = code_docs) -> DataFrame:
    """docs with content_type, clean_content (null where blank), word_count, char_count and error_class."""
    name, t = file_name(F.col(path)), F.col(text)
    kind = F.col("content_type")
    own = lambda k: F.when(kind == k, t)  # noqa: E731 - Python functions are run on every row, whatever the branch: others are null to them
    clean = F.when(kind == "html", F.coalesce(F.nullif(article_text(own("html")), F.lit("")), html_article(t))).when(kind == "code", code_text(t, language(name), symbols_of, docs_of)).when(kind == "pdf", pdf_clean(t)).when(kind == "email", email_text(own("email"))).when(kind == "markdown", markdown_text(own("markdown"))).otherwise(plain(t))
    out = docs.withColumn("content_type", content_type(name, t)).withColumn("clean_content", F.when(F.length(strip(clean)) > 0, clean))
    return out.withColumns({"word_count": word_count(F.col("clean_content")), "char_count": F.length("clean_content").cast("long"), "error_class": F.when(F.col("clean_content").isNull(), F.lit("EMPTY"))})
