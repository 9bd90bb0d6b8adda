"""Text functions of the evaluation, as expressions over columns.

All are built of Spark's own functions but for Unicode normal forms and Python
literals (``unicode``). With ``exact=False`` the normal forms are skipped, which is
right for text that has no compatibility or combining characters and keeps the
whole expression in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode as U

#: Signs beyond ASCII punctuation that count as punctuation.
MORE_PUNCTUATION = "¿¡“”«»—–·…"
#: White space as ``(?U)\\s`` has it.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a section holds when it holds nothing.
PLACEHOLDERS = ("", "n/a", "na", "none", "null", "[]", "{}", '""', "''", "-", "--")
#: What stands for a section without labels, and for one without a list of them.
NO_LABEL, MISSING_LABEL = "malo1", "malo2"
#: A private-use character that holds list items together.
_GLUE = "\ue000"
_IMAGE = r"(?i)\.(png|jpe?g|tiff?|bmp)$"


def joined(col: Column, is_list: bool) -> Column:
    """A list's non-empty items joined by spaces, or the text; null is empty."""
    return F.coalesce(F.array_join(F.filter(col, lambda x: x != ""), " ") if is_list else col, F.lit(""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def lowered(col: Column, is_list: bool = False, lowercase: bool = True, dehyphenate: bool = True, exact: bool = True) -> Column:
    """The first steps of T-01: NFKC, character-id marks off, hyphenated line ends joined, line
    ends to spaces, small letters."""
    given = joined(col, is_list)
    t = U.nfkc(given) if exact else given
    t = F.regexp_replace(t, r"\(cid:\d+\)", "")
    # No normal form makes or takes a line feed.
    t = F.when(F.contains(given, F.lit("\n")), F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")).otherwise(t) if dehyphenate else t
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    return F.lower(t) if lowercase else t


def normalize_text(col: Column, is_list: bool = False, lowercase: bool = True, remove_punct: bool = True, remove_diacritics: bool = False, dehyphenate: bool = True, exact: bool = True) -> Column:
    """T-01: ``lowered``, marks off, punctuation to spaces, spaces collapsed."""
    t = lowered(col, is_list, lowercase, dehyphenate, exact)
    t = U.strip_marks(t) if remove_diacritics else t
    t = without_punctuation(t) if remove_punct else t
    return collapse(t)


def without_punctuation(text: Column) -> Column:
    """Its signs as spaces."""
    return F.regexp_replace(text, rf"[\p{{Punct}}{MORE_PUNCTUATION}]", " ")


def normalize_section(text: Column, exact: bool = True) -> Column:
    """T-02: small letters, marks off, anything but a-z, 0-9 and white space to spaces."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = U.letters_unmarked(t) if exact else t
    # Other signs become spaces and white space is collapsed: each run of either is one space.
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def normalize_words(text: Column, exact: bool = True) -> Column:
    """T-03: T-01 with marks off, of one text."""
    return normalize_text(text, remove_diacritics=exact, exact=exact)


def split_words(text: Column) -> Column:
    """T-05, T-30: words between white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def clean_transcription(text: Column) -> Column:
    """T-04: slashes unescaped, list literals joined, one quote off each end."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\\\/"), F.lit("/")), F.lit("\\/"), F.lit("/"))
    items = U.literal_strings(t)
    bare = F.regexp_replace(F.regexp_replace(t, r'[\[\]"]', ""), r'^"|"$', "")
    plain = F.regexp_replace(t, r'^"|"$', "")
    return F.when(t.startswith("[") & t.endswith("]"), F.when(items.isNotNull(), F.array_join(items, " ")).otherwise(bare)).otherwise(plain)


def characters(text: Column) -> Column:
    """T-06."""
    return U.printable_characters(clean_transcription(text))


def words_from_chars(chars: Column, line_box: Column) -> Column:
    """T-07: words of character structs (text, x1, y1, x2, y2): runs between white-space or
    empty characters, with the hull of their valid boxes, else ``line_box``, else zeros."""
    empty = F.array().cast("array<double>")
    begin = F.struct(F.array().cast("array<struct<text:string,box:array<double>>>").alias("out"), F.lit("").alias("word"), empty.alias("box"))

    def closed(acc: Column) -> Column:
        box = F.when(F.size(acc["box"]) > 0, acc["box"]).otherwise(F.coalesce(line_box.cast("array<double>"), F.array(*[F.lit(0.0)] * 4)))
        return F.when(acc["word"] != "", F.concat(acc["out"], F.array(F.struct(acc["word"].alias("text"), box.alias("box"))))).otherwise(acc["out"])

    def read(c: Column) -> Column:
        own = F.when(c["x1"].isNotNull() & c["y1"].isNotNull() & c["x2"].isNotNull() & c["y2"].isNotNull(), F.array(c["x1"], c["y1"], c["x2"], c["y2"]).cast("array<double>"))
        text = F.coalesce(c["text"], F.lit(""))
        return F.struct(text.alias("text"), text.rlike(r"(?U)^\s*$").alias("gap"), own.alias("own"))

    def step(acc: Column, c: Column) -> Column:
        gap, own = c["gap"], c["own"]
        hull = F.when(own.isNull(), acc["box"]).when(F.size(acc["box"]) == 0, own).otherwise(F.array(F.least(acc["box"][0], own[0]), F.least(acc["box"][1], own[1]), F.greatest(acc["box"][2], own[2]), F.greatest(acc["box"][3], own[3])))
        return F.struct(
            F.when(gap, closed(acc)).otherwise(acc["out"]).alias("out"),
            F.when(gap, F.lit("")).otherwise(F.concat(acc["word"], c["text"])).alias("word"),
            F.when(gap, empty).otherwise(hull).alias("box"),
        )

    # What is asked of a character is made once for each, not wherever the fold uses it.
    return F.aggregate(F.transform(chars, read), begin, step, closed)


def word_texts(texts: Column) -> Column:
    """T-07 of characters' texts alone: one join and one split in place of a fold."""
    known = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    glued = F.array_join(F.transform(known, lambda t: F.when(t.rlike(r"(?U)^\s*$"), _GLUE).otherwise(t)), "")
    split = F.filter(F.split(glued, _GLUE), lambda w: w != "")
    bare = F.transform(known, lambda t: F.struct(t.alias("text"), *[F.lit(None).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")]))
    folded = F.transform(words_from_chars(bare, F.lit(None).cast("array<double>")), lambda w: w["text"])
    return F.when(F.exists(known, lambda t: F.contains(t, F.lit(_GLUE))), folded).otherwise(split)


def clean_b_tags(text: Column) -> Column:
    """T-08."""
    return F.replace(F.replace(text, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit(""))


def html_table_texts(html: Column) -> Column:
    """T-09."""
    return U.html_text_nodes(html)


def html_table_texts_of_each(htmls: Column) -> Column:
    """T-09, of each text of an array."""
    return U.html_text_nodes_of_each(htmls)


def edge_trimmed_words(text: Column) -> Column:
    """T-10: heading signs off the text's start, words without signs at their ends."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^#+\s*", "")
    return F.filter(F.transform(split_words(t), lambda w: F.regexp_replace(w, r"(?U)^[^\wÀ-ÿ]+|[^\wÀ-ÿ]+$", "")), lambda w: w != "")


def strip_heading(text: Column) -> Column:
    """T-11."""
    return F.regexp_replace(text, r"(?U)^\s*#+\s*", "")


def flatten_words(lines: Column) -> Column:
    """T-12: pieces between single spaces of every line, blank ones left out."""
    return F.filter(F.flatten(F.transform(F.filter(lines, lambda x: x.isNotNull()), lambda x: F.split(x, " "))), lambda w: ~w.rlike(r"(?U)^\s*$"))


def markdown_lines(pages: Column) -> Column:
    """T-13: pages (array of index, markdown) by index, as trimmed lines without heading signs."""
    texts = F.transform(F.array_sort(pages), lambda p: F.split(F.coalesce(p["markdown"], F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"))
    return F.filter(F.transform(F.flatten(texts), lambda x: strip_heading(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: x != "")


def clean_text(text: Column) -> Column:
    """T-14."""
    return F.regexp_replace(text, r"[\n\t\r]", " ")


def smart_tokenize(text: Column) -> Column:
    """T-15: opening signs joined to the next word, closing ones and lone hyphens to the
    one before, then split at spaces; null: no words."""
    t = F.regexp_replace(text, r"(?U)([(\[{])\s+", "$1")
    t = F.regexp_replace(t, r"(?U)\s+([.,;:!?|\])}])", "$1")
    t = F.regexp_replace(t, r"(?U)\s+(-)\s+", "$1")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(collapse(t), " "))


def to_plain_string(items: Column) -> Column:
    """T-16: single characters joined without, other items with a space between."""
    return F.when(items.isNull(), "").when((F.size(items) > 0) & F.forall(items, lambda x: F.length(x) == 1), F.array_join(items, "")).otherwise(F.array_join(items, " "))


def word_sequence(col: Column, is_list: bool, exact: bool = True) -> Column:
    """T-17, words: a list's items are normalised and not split again, a text is."""
    if is_list:
        # All items in one text, so that the normal form costs one call a row.
        glued = F.array_join(F.transform(col, lambda w: F.translate(w, _GLUE, " ")), _GLUE)
        return F.filter(F.transform(F.split(normalize_text(glued, exact=exact), _GLUE), lambda w: F.trim(w)), lambda w: w != "")
    return split_words(normalize_text(col, exact=exact))


def char_sequence(col: Column, is_list: bool, mode: str = "repr") -> Column:
    """T-17, characters. A list's ``repr`` is scored as it is written, brackets, quotes and
    commas included; ``joined`` scores its items' characters."""
    if is_list and mode == "repr":
        odd = F.exists(col, lambda x: x.isNull() | x.rlike(r"['\\\p{Cntrl}\p{Cn}\p{Co}\p{Zl}\p{Zp} ­]"))
        plain = F.when(F.size(col) > 0, F.concat(F.lit("['"), F.array_join(col, "', '"), F.lit("']"))).otherwise("[]")
        text = F.when(F.coalesce(odd, F.lit(False)), U.python_repr(col)).otherwise(plain)
    elif mode in ("repr", "joined"):
        text = F.array_join(col, "") if is_list else col
    else:
        raise ValueError(f"mode is repr or joined, not {mode!r}")
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def is_empty_section(text: Column) -> Column:
    """T-19, after T-02: "n/a" has become "n a" by then and isn't a placeholder."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return t.isin(*PLACEHOLDERS)


def gt_filename(path: Column) -> Column:
    """T-20: behind the last ``=`` and then the last ``/``; else behind the last ``-``."""
    after = F.element_at(F.split(F.element_at(F.split(path, "="), -1), "/"), -1)
    name = F.when(F.contains(path, F.lit("=")), after).otherwise(F.element_at(F.split(path, "-"), -1))
    return F.coalesce(F.regexp_replace(name, r"(?i)\.(png|jpg|jpeg)$", ""), F.lit(""))


def stem(path: Column) -> Column:
    """T-21: file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def cv_id(name: Column) -> Column:
    """T-22: what stands before ``_page_<n>``; null without it."""
    return F.nullif(F.regexp_extract(name, r"(?i)^(.*)_page_(\d+)$", 1), F.lit(""))


def page_number(name: Column) -> Column:
    """T-22: the page's number, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)^(.*)_page_(\d+)$", 2), F.lit("")).cast("int"), F.lit(0))


def safe_stem(name: Column) -> Column:
    """T-23."""
    return F.regexp_replace(name, _IMAGE, "")


def json_from_text(text: Column) -> Column:
    """T-24: the widest ``{...}``, else the widest ``[...]`` that is JSON, else the text
    and an error as JSON."""
    found = F.coalesce(*[F.when(U.is_strict_json(part), part) for part in (F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")))])
    return F.coalesce(found, F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("raw_output"), F.lit("no JSON found").alias("error"))))


def reordered_words(texts: Column, order: Column) -> Column:
    """T-25, T-26: words of the texts in a predicted order of places (from 0)."""
    return F.flatten(F.transform(F.filter(order, lambda i: (i >= 0) & (i < F.size(texts))), lambda i: split_words(F.get(texts, i))))


def data_url(name: Column, content: Column) -> Column:
    """T-27: ``data:<type>;base64,<content>``, type by file extension, PNG by default."""
    kind = F.when(name.rlike(r"(?i)\.jpe?g$"), "image/jpeg").when(name.rlike(r"(?i)\.webp$"), "image/webp").when(name.rlike(r"(?i)\.tiff?$"), "image/tiff").when(name.rlike(r"(?i)\.bmp$"), "image/bmp").otherwise("image/png")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))
