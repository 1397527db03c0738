"""Value generators: each turns the draw of a cell into a column expression."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from migraspark.functions.draws import Draw

Provider = Callable[[Draw], Column]

# Order statuses with their shares, and the country pool.
ORDER_STATUSES = ("COMPLETED", "SHIPPED", "DELIVERED", "PENDING", "CANCELLED", "REFUNDED")
ORDER_STATUS_WEIGHTS = (0.55, 0.20, 0.15, 0.05, 0.03, 0.02)
COUNTRIES = (
    "United States",
    "United Kingdom",
    "Canada",
    "Germany",
    "France",
    "Australia",
    "India",
    "Japan",
    "Brazil",
    "Mexico",
)

# Ranges of the type-based generators.
INTEGER_RANGE = (0, 10_000)
NORMAL = (500.0, 150.0)
NESTED_DECIMAL_RANGE = (0.0, 1000.0)
DATE_RANGE = ("2023-01-01", "2026-01-01")
SIZE_RANGE = (1, 5)
NULL_RATE = 0.05

FIRST_NAMES = (
    "Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gita", "Hugo", "Ines", "Jon", "Kira", "Liam",
    "Mona", "Nils", "Olga", "Paul", "Rosa", "Sven", "Tara", "Uwe", "Vera", "Will", "Yara", "Zoe",
)
LAST_NAMES = (
    "Abbott", "Berg", "Castro", "Dietz", "Engel", "Fischer", "Garcia", "Hansen", "Ito", "Jones",
    "Klein", "Lopez", "Meyer", "Novak", "Okafor", "Patel", "Quinn", "Rossi", "Sato", "Turner",
    "Usman", "Vogel", "Weber", "Young",
)
CITIES = (
    "Ashford", "Brookdale", "Clearwater", "Dunmore", "Eastfield", "Fairview", "Glenwood",
    "Hillcrest", "Ironbridge", "Kingsport", "Lakeside", "Millbrook", "Northgate", "Oakridge",
    "Pinehurst", "Riverton", "Southport", "Thornbury", "Westbrook", "Yarrow",
)
STREETS = ("Main", "Oak", "Park", "Cedar", "Lake", "Hill", "Mill", "Church", "Station", "Garden")
COMPANY_ENDINGS = ("Ltd", "Inc", "Group", "and Sons", "Partners")
WORDS = (
    "amber", "basket", "canyon", "delta", "ember", "forest", "garden", "harbor", "island",
    "jacket", "kernel", "ladder", "meadow", "needle", "orchard", "pebble", "quarry", "ribbon",
    "saddle", "timber", "umbrella", "valley", "window", "yellow", "zephyr", "anchor", "bridge",
    "copper", "drift", "engine", "feather", "granite",
)


def first_name(draw: Draw) -> Column:
    return draw.pick(FIRST_NAMES, "first")


def last_name(draw: Draw) -> Column:
    return draw.pick(LAST_NAMES, "last")


def person_name(draw: Draw) -> Column:
    return F.concat_ws(" ", first_name(draw), last_name(draw))


def username(draw: Draw) -> Column:
    number = draw.integer(1, 1000, "number").cast("string")
    return F.concat(F.lower(first_name(draw)), F.lower(last_name(draw)), number)


def email(draw: Draw) -> Column:
    return F.concat(username(draw), F.lit("@example.com"))


def address(draw: Draw) -> Column:
    number = draw.integer(1, 1000, "house").cast("string")
    return F.concat(
        number, F.lit(" "), draw.pick(STREETS, "street"), F.lit(" St, "), city(draw)
    )


def city(draw: Draw) -> Column:
    return draw.pick(CITIES, "city")


def country(draw: Draw) -> Column:
    return draw.pick(COUNTRIES, "country")


def phone(draw: Draw) -> Column:
    def block(size: int, salt: str) -> Column:
        number = draw.integer(0, 10**size, salt).cast("string")
        return F.lpad(number, size, "0")

    return F.concat_ws("-", block(3, "area"), block(3, "exchange"), block(4, "line"))


def company(draw: Draw) -> Column:
    return F.concat_ws(" ", last_name(draw), draw.pick(COMPANY_ENDINGS, "ending"))


def uuid(draw: Draw) -> Column:
    text = draw.digits(32, "uuid")
    spans = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(text, start, size) for start, size in spans])


def url(draw: Draw) -> Column:
    return F.concat(
        F.lit("https://"), draw.pick(WORDS, "host"), F.lit(".example.com/"), draw.pick(WORDS, "path")
    )


def password(draw: Draw) -> Column:
    return F.concat(F.lit("p"), draw.digits(11, "password"))


def word(draw: Draw) -> Column:
    return draw.pick(WORDS, "word")


def words(draw: Draw) -> Column:
    return F.concat_ws(" ", *[draw.pick(WORDS, f"word{i}") for i in (1, 2)])


def sentence(draw: Draw) -> Column:
    rest = F.concat_ws(" ", *[draw.pick(WORDS, f"word{i}") for i in range(2, 7)])
    return F.concat(F.initcap(draw.pick(WORDS, "word1")), F.lit(" "), rest, F.lit("."))


def order_status(draw: Draw) -> Column:
    return draw.weighted(ORDER_STATUSES, ORDER_STATUS_WEIGHTS, "status")


PROVIDERS: dict[str, Provider] = {
    "email": email,
    "name": person_name,
    "first_name": first_name,
    "last_name": last_name,
    "address": address,
    "city": city,
    "country": country,
    "phone": phone,
    "mobile": phone,
    "company": company,
    "uuid": uuid,
    "url": url,
    "website": url,
    "username": username,
    "password": password,
    "word": word,
    "words": words,
    "sentence": sentence,
    "order_status": order_status,
}

# Providers that a column gets by its exact name, or that name with ``_id``.
EXACT_HINTS = (
    "email", "name", "first_name", "last_name", "address", "city", "country", "phone", "mobile",
    "company", "uuid", "url", "website", "username", "password",
)

# Then the first of these whose text is contained in the name decides.
PARTIAL_HINTS = (
    (("email",), "email"),
    (("phone", "mobile"), "phone"),
    (("first_name", "fname"), "first_name"),
    (("last_name", "lname"), "last_name"),
    (("full_name", "name"), "name"),
    (("address",), "address"),
    (("city",), "city"),
    (("company",), "company"),
    (("url", "website"), "url"),
    (("username",), "username"),
    (("uuid", "guid"), "uuid"),
)


def register_provider(name: str, provider: Provider) -> None:
    """Add a value provider: a function from the cell's draw to a column expression.

    Prefer built-in functions; a ``pandas_udf`` applied to ``draw.uniform()`` works as well.
    """
    PROVIDERS[name] = provider


def hinted_provider(name: str) -> str | None:
    """The provider a column name implies."""
    lower = name.lower()
    for hint in EXACT_HINTS:
        if lower in (hint, f"{hint}_id"):
            return hint
    if lower == "status":
        return "order_status"
    for parts, provider in PARTIAL_HINTS:
        if any(part in lower for part in parts):
            return provider
    return None


def integer(draw: Draw, low: int = INTEGER_RANGE[0], high: int = INTEGER_RANGE[1]) -> Column:
    return draw.integer(low, high)


def decimal_normal(draw: Draw) -> Column:
    return F.round(draw.normal(*NORMAL), 2)


def decimal_uniform(
    draw: Draw, low: float = NESTED_DECIMAL_RANGE[0], high: float = NESTED_DECIMAL_RANGE[1]
) -> Column:
    return F.round(F.lit(float(low)) + draw.uniform() * F.lit(float(high - low)), 2)


def _epoch(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp())


def timestamp(draw: Draw, start: str = DATE_RANGE[0], end: str = DATE_RANGE[1]) -> Column:
    """Whole seconds in [start, end), as wall-clock time."""
    second = draw.integer(_epoch(start), _epoch(end))
    return F.timestamp_seconds(second).cast("timestamp_ntz")


def coin(draw: Draw) -> Column:
    return draw.uniform() < F.lit(0.5)
