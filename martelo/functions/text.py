"""Text as column expressions: comparison forms, slugs, keys, redaction."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def decomposed(text: str) -> str:
    """Compatibility decomposition without marks, in plain Python."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def plain(text: str) -> str:
    """`comparable` in full, in plain Python: for what a table function reads from pages."""
    return " ".join(decomposed(text).lower().split())


def _letters(codes: range) -> tuple[str, str, str, str]:
    """Letters with the one letter that their decomposition leaves; marks, of which nothing is left; and a class of
    those of which several are left."""
    one, marks, several = {}, [], []
    for c in map(chr, codes):
        if "\ud800" <= c <= "\udfff" or (left := decomposed(c)) == c:
            continue
        if len(left) == 1:
            one[c] = left
        else:
            (several if left else marks).append(c)
    return "".join(one), "".join(one.values()), "".join(marks), "".join(several)


#: Letters that a worker decomposes before it gives them back.
SLICE_LETTERS = 1 << 20
#: Latin letters with marks and ordinal signs, with the plain letter of each.
ACCENTED, UNACCENTED = _letters(range(0xAA, 0x180))[:2]
#: The same of the whole basic plane, its marks, and the letters that become several.
LETTERS, PLAIN_LETTERS, MARKS, SEVERAL = _letters(range(0x80, 0x10000))


def unaccented(c: Column) -> Column:
    """Letters without marks. Same length as before, so that offsets hold: marks on their own and letters that become
    several stay (see `decomposed_column`)."""
    return F.translate(c, LETTERS, PLAIN_LETTERS)


def _hard() -> str:
    """A class of the letters that a translation can't decompose, as ranges."""
    runs: list[list[int]] = []
    for code in map(ord, sorted(SEVERAL + MARKS)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    # most letters fail the short test before the long class
    return r"(?=[^\x00-\x7f])[" + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in runs) + "\\x{10000}-\\x{10ffff}]"


def decomposed_column(c: Column) -> Column:
    """A struct of the text decomposed in full, without marks, and `starts`: for each letter of it the place (from 0)
    of the letter it comes from, so that a place found in it is told of the original; null where places are the same.

    Only texts with marks, ligatures or letters beyond the basic plane are sent to Python; null gives a null text.
    Marks are put in canonical order first, but as all go, places stay in order.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    made = StructType([StructField("plain", StringType()), StructField("starts", ArrayType(IntegerType()))])

    @F.pandas_udf(made, F.PandasUDFType.SCALAR_ITER)
    def slow(batches):
        import numpy as np
        import pandas as pd

        letter = lru_cache(maxsize=1 << 16)(decomposed)

        def one(text):
            if text is None:
                return None, None
            pieces = list(map(letter, text))
            return "".join(pieces), np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])

        # places take four bytes a letter and are given back in slices; a longer text is one by itself
        for texts in batches:
            rows, size = [], 0
            for text in texts:
                rows.append(one(text))
                size += len(text or "")
                if size > SLICE_LETTERS:
                    yield pd.DataFrame(rows, columns=["plain", "starts"])
                    rows, size = [], 0
            if rows or not len(texts):
                yield pd.DataFrame(rows, columns=["plain", "starts"])

    hard = c.rlike(_hard())
    found = slow(F.when(hard, c))
    return F.struct(F.when(hard, found["plain"]).otherwise(unaccented(c)).alias("plain"), F.when(hard, found["starts"]).alias("starts"))


def original_place(decomposed: Column, place: Column) -> Column:
    """The place in the original of a place (from 0) in `decomposed`, a struct of decomposed_column."""
    return F.when(decomposed["starts"].isNull(), place).otherwise(F.get(decomposed["starts"], place))


def comparable(c: Column) -> Column:
    """Lower case, no accents or marks, single blanks, trimmed; null gives ''. Letters that become several stay."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.translate(c, LETTERS + MARKS, PLAIN_LETTERS)), r"[\s ]+", " ")), F.lit(""))


def tidy(c: Column) -> Column:
    """Single blanks, trimmed; nothing left gives null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"[\s ]+", " ")), F.lit(""))


def slug(c: Column, most: int = 80) -> Column:
    """Words joined by hyphens; 'sem-nome' when nothing is left."""
    made = F.regexp_replace(F.regexp_replace(comparable(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(made, 1, most), F.lit("")), F.lit("sem-nome"))


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts between bars; a null part is empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def natural_key(court: Column, case: Column, lot: Column, source: Column, key: Column) -> Column:
    """Court, case and lot where there is a case; otherwise the source and the first half of the content key."""
    known = F.concat_ws("|", F.coalesce(court, F.lit("NA")), case, F.coalesce(F.nullif(comparable(lot), F.lit("")), F.lit("unico")))
    return F.when(case.isNotNull(), known).otherwise(F.concat_ws("|", source, F.substring(key, 1, 32)))


def holds_all(body: Column, terms: list[str]) -> Column:
    """Every term, as a substring of the comparable body."""
    return reduce(lambda a, b: a & b, (F.contains(body, F.lit(t)) for t in terms), F.lit(True))


def masked_plate(c: Column) -> Column:
    """'abc 1d23' to 'ABC1**3'; null without a plate."""
    up = F.trim(F.upper(c))
    at = lambda n: F.regexp_extract(up, r"\b([A-Z]{3})[- ]?(\d)([A-Z0-9])(\d{2})\b", n)
    return F.when(at(1) != "", F.concat(at(1), at(2), F.lit("**"), F.substring(at(4), 2, 1)))


def without_cpf(c: Column) -> Column:
    return F.regexp_replace(c, r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "[CPF removido]")


def districts(c: Column) -> Column:
    """A written list of districts as an array: parted at ; , / and ' e ', entries of over two letters."""
    return F.filter(F.transform(F.split(c, r"[;,/]|\s+e\s+"), F.trim), lambda x: F.length(x) > 2)


def repaired_pdf(c: Column) -> Column:
    """Text layers of PDF pages: line ends, broken words, runs of blanks, split decimals."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, "[ \t ]+", " ")
    c = F.regexp_replace(c, r"(\d)[ ]*,[ ]*(\d{2})\b", "$1,$2")
    return F.trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def first_email(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)), F.lit(""))


def first_phone(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4})", 1), F.lit(""))


def first_site(hrefs: Column) -> Column:
    """The first web address of a list that is no court's or government's."""
    return F.get(F.filter(hrefs, lambda h: h.rlike("(?i)^https?://") & ~h.rlike(r"(?i)(?:jus|gov)\.br(?:/|$)")), F.lit(0))


def comarca_label(c: Column) -> Column:
    """The name after 'comarca de', 'circunscrição de' or 'foro de' in running text."""
    return tidy(F.nullif(F.regexp_extract(c, r"(?i)(?:comarca|circunscri[cç][aã]o|foro)\s+(?:judici[aá]ria\s+)?(?:de|da|do)\s+([A-ZÁÂÃÉÊÍÓÔÕÚÇ][\wÀ-ÿ'\s-]{2,60})", 1), F.lit("")))


def evidence(original: Column, start: Column, end: Column, margin: int = 110) -> Column:
    """The original around [start, end) (from 0), tidied and cut at 600 letters."""
    low = F.greatest(start - margin, F.lit(0))
    return F.substring(tidy(F.substr(original, low + 1, end + margin - low)), 1, 600)


def humanised(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def ics_escaped(c: Column) -> Column:
    made = F.coalesce(c, F.lit(""))
    for old, new in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        made = F.replace(made, F.lit(old), F.lit(new))
    return made


def brazilian_money(c: Column) -> Column:
    """1234.5 as 'R$ 1.234,50'; null as 'não informado'."""
    return F.coalesce(F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,")), F.lit("não informado"))
