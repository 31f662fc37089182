"""Normal forms of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as outer white space.
BLANKS = " \t\n\r\f\x0b\x85\xa0"


def strip(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def normal_uri(c: Column) -> Column:
    """The plain spelling of a URI; NULL for NULL, blank and empty input.

    Outer white space, percent-encoding, the letter case of the scheme and slashes at the end do not matter; all else
    is case-sensitive. A percent sign that starts no valid escape is kept as it is.
    """
    plain = strip(c)
    decoded = F.when(
        plain.contains("%"), F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    ).otherwise(plain)
    bare = F.rtrim(strip(decoded), F.lit("/"))
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    lowered = F.concat(F.lower(scheme), F.substring(bare, F.length(scheme) + 1, 1 << 30))
    # most are plain as they are, and four cheap tests tell: the rest is neither evaluated for them nor repeated by filters
    usual = c.startswith("at://") & ~c.contains("%") & ~F.substring(c, -1, 1).isin([*BLANKS, "/"])
    return F.when(usual, c).when(F.length(bare) > 0, lowered)


#: The forms a UUID is written in.
UUID_FORM = r"^(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"


def normal_uuid(c: Column) -> Column:
    """A UUID as 32 lower-case hexadecimal digits, NULL for anything that is no UUID in a usual spelling."""
    plain = F.lower(strip(c))
    return F.when(plain.rlike(UUID_FORM), F.regexp_replace(plain, UUID_FORM, "$1$2$3$4$5"))
