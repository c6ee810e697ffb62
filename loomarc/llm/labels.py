"""Language labels in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of language labels by the code they mean.
SPELLINGS = {
    "zh": "zh zho chi cn chinese mandarin 中文 汉语 漢語 chinois chinesisch", "en": "en eng english anglais englisch inglés inglês",
    "ja": "ja jpn jp japanese 日本語 japonais japanisch", "de": "de deu ger german deutsch allemand alemán alemão", "fr": "fr fra fre french français französisch",
    "es": "es spa spanish español castellano espagnol spanisch", "pt": "pt por portuguese português portugais portugiesisch", "ru": "ru rus russian русский russe russisch",
    "python": "python py", "java": "java", "csharp": "csharp c# cs",
}
CODES = {spelling: code for code, spellings in SPELLINGS.items() for spelling in spellings.split()}
PROSE = ("zh", "en", "ja", "de", "fr", "es", "pt", "ru")
CODE = ("python", "java", "csharp")


def language_code(label: str | None) -> str | None:
    """The code of one label; None where it names no known language."""
    if label is None:
        return None
    plain = label.strip().lower()
    return CODES.get(plain) or CODES.get(plain.replace("_", "-").split("-")[0].strip())


def language_code_column(label: Column) -> Column:
    """The same as a column expression (stays in the JVM)."""
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    base = F.regexp_replace(F.element_at(F.split(plain, "[-_]"), 1), r"(?U)\s+$", "")
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, base))
