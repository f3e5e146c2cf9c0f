"""Text out of stored bytes, pages, delimited files and program code, and signs of machine noise in it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docspark.operators.lexical import text_lines_to_nodes

#: Elements without visible text, and those that begin a line.
HIDDEN = ("script", "style", "noscript")
BREAKING = ("p", "div", "br", "li", "h1", "h2", "h3", "tr")
#: Characters that pages name; others come as numbers. The ampersand goes last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "times": "×", "euro": "€", "deg": "°", "amp": "&"}
#: Those of them that need no semicolon.
OPEN = ("lt", "gt", "quot", "nbsp", "copy", "reg", "middot", "laquo", "raquo", "times", "deg", "amp")
#: Words that may stand before a definition, and words that begin one.
MODIFIERS = ("pub", "public", "private", "protected", "internal", "static", "export", "default", "abstract", "final", "open")
DEFINING = ("def", "class", "fn", "func", "function", "interface", "struct", "enum", "trait", "impl", "record", "module")
VARIABLES = ("const", "let", "var")


def _any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


_NAME, _LINE = r"([A-Za-z_$][\w$]*)", r"^\s*"
#: Definitions at the beginning of a line, by kind; the group is the name: a defining word and a name, a variable that is given a function,
#: and a name with empty brackets before a brace.
SYMBOLS = (
    _LINE + f"(?:{_any_of(MODIFIERS)}\\s+)*(?:async\\s+)?{_any_of(DEFINING)}\\s+{_NAME}",
    _LINE + f"{_any_of(VARIABLES)}\\s+{_NAME}\\s*=.*(?:=>|function\\b)",
    _LINE + r"(?:function\s+)?([A-Za-z_]\w*)\s*\(\s*\)\s*\{",
)
#: GB18030, byte by byte as Latin-1 characters: single bytes, pairs, and groups of four, each where the one before ended.
GB18030 = r"\G(?:[\x00-\x7F]+|[\x81-\xFE](?:[\x40-\x7E\x80-\xFE]|[\x30-\x39][\x81-\xFE][\x30-\x39]))"


@F.pandas_udf(StringType())
def _from_gb18030(content: pd.Series) -> pd.Series:
    return content.str.decode("gb18030", errors="replace")


def decode_text(content: Column | str) -> Column:
    """Binary column as UTF-8 without its mark, else GB18030, else UTF-8 with replacements; null stays null.

    UTF-8 is told and read by built-in functions; only rows that have GB18030's structure and aren't UTF-8 go to Python.
    """
    content = F.col(content) if isinstance(content, str) else content
    utf8 = content.cast("string")
    other = ~F.is_valid_utf8(utf8) & (F.regexp_replace(F.decode(content, "ISO-8859-1"), GB18030, "") == "")
    return F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "^\ufeff", "")).when(other, _from_gb18030(F.when(other, content))).otherwise(F.make_valid_utf8(utf8))


def visible_html(page: Column) -> Column:
    """Text outside comments, declarations and hidden elements; elements that begin a line part words; white space folded."""
    t = F.regexp_replace(page, r"(?s)<!--.*?(?:-->|\z)", "")
    for tag in HIDDEN:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "")
    t = F.regexp_replace(t, rf"(?i)<(?:{'|'.join(BREAKING)})(?:[\s/][^>]*)?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[/!?A-Za-z][^>]*(?:>|\z)", "")
    numbers = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), 0))
    digits = lambda e: F.regexp_replace(e, "[&#xX;]", "")
    point = lambda e: F.when(e.rlike("[xX]"), F.conv(digits(e), 16, 10)).otherwise(digits(e)).cast("int")
    # Four bytes of UTF-32 make a character; what is none becomes the replacement character.
    char = lambda e: F.decode(F.unhex(F.lpad(F.hex(point(e)), 8, "0")), "UTF-32")
    t = F.aggregate(numbers, t, lambda acc, e: F.replace(acc, e, char(e)))
    for name, value in ENTITIES.items():
        t = F.regexp_replace(t, f"&{name};?" if name in OPEN else f"&{name};", value)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def html_visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, text``: visible text of each page; null pages give null."""
    return pages.select(id_col, visible_html(F.col(html_col)).alias("text"))


def delimited_rows(docs: DataFrame, separator: str = ",", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, cells``: rows of delimited texts from 0; quoted cells may hold separators, line breaks and doubled quotes."""
    cell = rf'("[^"]*(?:""[^"]*)*"[^{separator}\r\n]*|[^{separator}\r\n]*)({separator}|\r\n|\n|\r|\z)'
    parts = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(cell), 1).alias("c"), F.regexp_extract_all(text_col, F.lit(cell), 2).alias("e"))
    cells = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("pos", "p")).select("doc_id", "pos", F.col("p.c").alias("c"), F.col("p.e").alias("e"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    row = F.coalesce(F.count_if(F.col("e").rlike("[\r\n]")).over(before), F.lit(0))
    plain = F.when(F.col("c").startswith('"'), F.replace(F.regexp_replace("c", '^"([^"]*(?:""[^"]*)*)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(F.col("c"))
    # The end of a text matches once more, with nothing before it: that is no cell unless a separator came before.
    cells = cells.withColumns({"row": row, "plain": plain, "last": F.lag("e", 1, "\n").over(Window.partitionBy("doc_id").orderBy("pos"))})
    cells = cells.filter((F.col("c") != "") | (F.col("e") != "") | (F.col("last") == separator))
    return cells.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "plain"))), lambda x: x["plain"]).alias("cells"))


def delimited_to_nodes(docs: DataFrame, separator: str = ",", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of delimited texts, cells joined by `` | ``, as paragraph nodes; a cell's line breaks begin nodes too."""
    rows = delimited_rows(docs, separator, id_col, text_col).select("doc_id", "row", F.array_join("cells", " | ").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    return text_lines_to_nodes(rows.groupBy("doc_id").agg(text.alias("text")))


def code_to_nodes(docs: DataFrame, block: int = 120, format_col: str | None = None) -> DataFrame:
    """``doc_id, ordinal, node_type, symbol, line_start, line_end, text, heading_path`` of program code (``doc_id, text``).

    ``heading_path`` has the language of ``format_col``, where that is given and not null, and the symbol, where there is one.

    A symbol's node runs from its definition to the next; what stands before the first, if not blank, is a block. Texts
    without symbols are blocks of ``block`` lines. A text's lines are numbered where the text is, so no hot key arises.
    """
    language = (F.col(format_col) if format_col else F.lit(None).cast("string")).alias("language")
    lines = docs.select("doc_id", language, F.posexplode(F.split(F.regexp_replace("text", r"(?:\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")).alias("pos", "line"))
    found = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in SYMBOLS])
    whole = Window.partitionBy("doc_id")
    upto = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("symbol", found).withColumns({"part": F.count("symbol").over(upto), "symbols": F.count("symbol").over(whole)})
    lines = lines.withColumn("part", F.when(F.col("symbols") == 0, F.floor(F.col("pos") / block)).otherwise(F.col("part")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    nodes = lines.groupBy("doc_id", "part").agg(F.max("symbol").alias("symbol"), F.max("language").alias("language"), (F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"))
    nodes = nodes.filter("text != ''").withColumn("ordinal", F.row_number().over(whole.orderBy("line_start")))
    return nodes.select("doc_id", "ordinal", F.when(F.col("symbol").isNull(), "code_block").otherwise("code_symbol").alias("node_type"), "symbol", "line_start", "line_end", "text", F.array_compact(F.array("language", "symbol")).alias("heading_path"))


#: Media types of extensions.
MIME_OF_EXTENSION = {
    "application/pdf": ("pdf",),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("docx", "docm"),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("xlsx", "xlsm"),
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ("pptx", "pptm"),
    "application/msword": ("doc",),
    "application/vnd.ms-excel": ("xls",),
    "application/vnd.ms-powerpoint": ("ppt",),
    "text/csv": ("csv",),
    "text/tab-separated-values": ("tsv",),
    "text/plain": ("md", "txt", "text", "ini", "iml", "log", "conf", "cfg", "properties", "java", "kt", "kts", "go", "c", "cc", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "scala", "sh", "ps1", "sql", "json", "yaml", "yml", "toml", "xml", "css", "scss", "vue", "svelte"),
    "text/html": ("html", "htm"),
    "application/zip": ("zip",),
    "application/x-7z-compressed": ("7z",),
    "application/vnd.rar": ("rar",),
    "application/vnd.microsoft.portable-executable": ("exe", "dll"),
    "application/x-msi": ("msi",),
    "audio/mpeg": ("mp3",),
    "audio/wav": ("wav",),
    "audio/flac": ("flac",),
    "audio/mp4": ("m4a",),
    "video/mp4": ("mp4",),
    "video/x-matroska": ("mkv",),
    "video/quicktime": ("mov",),
    "video/x-msvideo": ("avi",),
    "video/webm": ("webm",),
    "text/x-rust": ("rs",),
    "text/x-python": ("py",),
    "text/javascript": ("js", "jsx", "mjs", "cjs"),
    "text/typescript": ("ts", "tsx"),
    "image/jpeg": ("jpg", "jpeg"),
    "image/png": ("png",),
    "image/tiff": ("tif", "tiff"),
    "image/bmp": ("bmp",),
    "image/webp": ("webp",),
}
#: First bytes, in hexadecimal digits.
MAGIC = {
    "application/pdf": "255044462D",
    "application/zip": "504B0304",
    "image/png": "89504E470D0A1A0A",
    "image/jpeg": "FFD8FF",
    "application/vnd.sqlite3": "53514C69746520666F726D6174203300",
    "application/vnd.microsoft.portable-executable": "4D5A",
}


def detect_mime(extension: Column, content: Column, header: int = 4096) -> Column:
    """Media type by extension (lower case), else by the first bytes, else plain text or unknown.

    Plain text: the first ``header`` bytes are UTF-8 with at most one per cent of control bytes (line feeds, returns and
    tabs apart). Null content counts as empty, which is unknown.
    """
    known = F.lit(None).cast("string")
    for mime, extensions in MIME_OF_EXTENSION.items():
        known = F.when(extension.isin(*extensions), mime).otherwise(known)
    first = F.substring(content, 1, header)
    start, text = F.hex(F.substring(content, 1, 16)), first.cast("string")
    by_magic = F.lit(None).cast("string")
    for mime, magic in MAGIC.items():
        by_magic = F.when(start.startswith(magic), mime).otherwise(by_magic)
    control = F.regexp_count(F.when(F.is_valid_utf8(text), text), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    plain = (F.octet_length(first) > 0) & F.is_valid_utf8(text) & (control * 100 <= F.octet_length(first))
    return F.coalesce(known, by_magic, F.when(plain, "text/plain"), F.lit("application/octet-stream"))


def noise_flags(text: Column) -> tuple[Column, Column]:
    """Markup control and opaque encoding in a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size, hexes = F.greatest(F.length(text), F.lit(1)), lambda t: F.length(F.regexp_replace(t, "[^0-9a-fA-F]", ""))
    marks = F.length(F.regexp_replace(text, r"[^\\{};]", ""))
    markup = F.lower(text).rlike(r"\\rtf|\\ansi|\\fonttbl") | (marks * 5 > size) | (F.regexp_count(text, F.lit(r"\\[A-Za-z]{2,}")) >= 3)
    opaque = F.exists(F.split(text, r"(?U)[\s=:,]"), lambda t: hexes(t) >= 48) | ((hexes(text) * 4 > size * 3) & (size >= 80))
    return markup, opaque


def noise_summary(text: Column) -> Column:
    """What to show in place of noise: its kind, characters and distinct words; null for a text that isn't noise."""
    markup, opaque = noise_flags(text)
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)))
    about = F.concat_ws(" ", F.length(text).cast("string"), F.lit("characters,"), words.cast("string"), F.lit("words"))
    return F.when(markup, F.concat(F.lit("Markup control text: "), about)).when(opaque, F.concat(F.lit("Encoded data: "), about))
