"""Dates found in running text, as expressions: ordered patterns, the first hit of each is tried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names.
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10,
    "novembro": 11, "dezembro": 12,
}
#: Patterns and what their groups hold.
PATTERNS = [
    (r"(?<!\w)(\d{1,2})/(\d{1,2})/(\d{4})(?!\w)", ("d", "m", "y")),
    (r"(?<!\w)(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\w)", ("d", "m", "y")),
    (r"(?<!\w)(\d{1,2})[º°]?\s+de\s+([A-Za-zçÇãÃéÉíÍóÓôÔ]+)\s+de\s+(\d{4})(?!\w)", ("d", "name", "y")),
    (r"(?<!\d)(?<!\d[-./])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![-./]?\d)", ("y", "sep", "m", "d")),
    (r"(?<!\d)(?<!\d[-./])(\d{1,2})-(\d{1,2})-(\d{4})(?![-./]?\d)", ("d", "m", "y")),
]


def first_date(text: Column) -> Column:
    """YYYY-MM-DD of the first pattern whose first hit is a day of the calendar, else null."""
    names = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(str(v)))])

    def tried(pattern: str, groups: tuple[str, ...]) -> Column:
        of = {g: F.regexp_extract(text, pattern, i + 1) for i, g in enumerate(groups)}
        month = of["m"] if "m" in of else F.coalesce(F.try_element_at(names, F.lower(of["name"])), F.lit("0"))
        iso = F.concat_ws("-", of["y"], F.lpad(month, 2, "0"), F.lpad(of["d"], 2, "0"))
        return F.when(text.rlike(pattern) & iso.try_cast("date").isNotNull(), iso)

    return F.coalesce(*[tried(p, g) for p, g in PATTERNS])
