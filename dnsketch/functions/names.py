"""Host names as columns: normalising, tokens, suffixes, reverse pointers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsketch.model import UNKNOWN


def normalised(qname: Column | str) -> Column:
    """Without one trailing dot, lower case."""
    return F.lower(F.regexp_replace(qname, r"\.$", ""))


def evaluated(qname: Column | str) -> Column:
    """As the evaluations compare names: without trailing dots and outer blanks, case kept."""
    return F.trim(F.regexp_replace(qname, r"\.+$", ""))


def tokens(host: Column, qtype: Column, entity: Column | None = None, entity_sld: bool = False) -> Column:
    """The array of strings that one lookup adds to a sketch.

    The host; for other types than PTR also each label but the last and the last two labels (the empty string for a
    single label); with an entity, `entity@` before the host and before each label. entity_sld adds `entity@` before the
    last two labels, which the sketch does not hold by default.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    own = F.slice(labels, 1, n - 1)
    sld = F.when(n > 1, F.concat_ws(".", F.slice(labels, n - 1, 2))).otherwise("")
    plain = F.when(qtype == "PTR", F.array(host)).otherwise(F.concat(F.array(host), own, F.array(sld)))
    if entity is None:
        return plain

    def tag(x: Column) -> Column:
        return F.concat(entity, F.lit("@"), x)

    tagged = F.when(qtype == "PTR", F.array(tag(host))).otherwise(F.concat(F.array(tag(host)), F.transform(own, tag)))
    if entity_sld:
        tagged = F.when(qtype == "PTR", tagged).otherwise(F.concat(tagged, F.array(tag(sld))))
    return F.concat(plain, tagged)


def entity_or_unknown(entity: Column) -> Column:
    return F.coalesce(entity, F.lit(UNKNOWN))


def suffixes(host: Column) -> Column:
    """The host and each suffix behind a dot, the last label included."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def registrable(host: Column) -> Column:
    """The last two labels, the fallback where no list of public suffixes is at hand."""
    return F.substring_index(host, ".", -2)


def reverse_pointer(ip: Column) -> Column:
    """IPv4 text -> name below in-addr.arpa."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(ip, r"\."))), F.lit(".in-addr.arpa"))


def reverse_pointer6(hex32: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address -> name below ip6.arpa."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(F.lower(hex32), ""))), F.lit(".ip6.arpa"))


def whole_number(text: Column, least: int, most: int) -> Column:
    """Decimal digits and nothing else, within the range; null otherwise."""
    n = F.when(text.rlike(r"^[0-9]{1,20}$"), text).cast("decimal(20,0)")
    return F.when(n.between(least, most), n.cast("long"))


def entity_part(token: Column) -> Column:
    """What stands before the first @; null without one."""
    return F.when(F.contains(token, F.lit("@")), F.substring_index(token, "@", 1))


def host_part(token: Column) -> Column:
    """What stands behind the first @; the whole token without one."""
    return F.regexp_replace(token, r"^[^@]*@", "")
