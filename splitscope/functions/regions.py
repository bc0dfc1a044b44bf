"""Country code -> region label.

FIXED VALUES: the five region lists below must equal the published mapping
byte for byte (labels included); any other or missing code maps to 'Other'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER_REGION = "Other"

# Fixed values (published mapping), in their published order.
REGION_COUNTRIES: dict[str, tuple[str, ...]] = {
    "North America": ("US", "CA"),
    "Europe": (
        "GB", "FR", "DE", "IT", "ES", "NL", "BE", "SE", "NO", "DK", "FI", "IE", "AT", "CH",
        "PT", "PL", "CZ", "GR", "RU", "UA", "BY",
    ),
    "LATAM": ("BR", "MX", "AR", "CO", "CL", "PE", "EC", "BO", "CR", "GT", "HN", "NI", "PA", "PY", "SV", "UY", "VE"),
    "Asia-Pacific": (
        "IN", "ID", "PH", "TH", "VN", "MY", "SG", "PK", "BD", "MM", "KH", "LA", "NP", "LK", "CN", "JP",
        "KR", "TW", "HK", "MO", "AU", "NZ",
    ),
    "MEA (Middle East & Africa)": (
        "AE", "SA", "IL", "TR", "EG", "IQ", "JO", "KW", "LB", "OM", "QA", "BH", "IR", "PS", "SY", "ZA",
        "NG", "KE", "GH", "ET", "TZ", "UG", "ZW", "ZM", "MA", "DZ", "TN", "CI", "CM", "SN", "MZ", "MU",
        "GA", "CG", "CV", "SO", "DJ", "GM", "SZ", "ML", "MG", "SC", "GQ", "GW", "MR", "LC",
    ),
}


def region_of(country: Column | str) -> Column:
    """CASE over the code lists; Catalyst turns each IN list into a hash-set probe."""
    c = F.col(country) if isinstance(country, str) else country
    expr = None
    for region, codes in REGION_COUNTRIES.items():
        cond = c.isin(*codes)
        expr = F.when(cond, F.lit(region)) if expr is None else expr.when(cond, F.lit(region))
    return expr.otherwise(F.lit(OTHER_REGION))


def region_case_sql(country: str = "country") -> str:
    """The same mapping as a SQL CASE (for the SQL of catalog views)."""
    parts = ["CASE"]
    for region, codes in REGION_COUNTRIES.items():
        lst = ", ".join(f"'{c}'" for c in codes)
        parts.append(f" WHEN {country} IN ({lst}) THEN '{region}'")
    parts.append(f" ELSE '{OTHER_REGION}' END")
    return "".join(parts)
