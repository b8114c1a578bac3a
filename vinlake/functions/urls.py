"""Addresses: hosts, and what two addresses of the same picture share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions.once import bound


def host(url: Column) -> Column:
    """In lower case, without www.; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def plain(url: Column) -> Column:
    """Without query, fragment and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")


def picture(url: Column) -> Column:
    """Host and path of a picture without what only sets its size: a size folder, a size before the ending, and the ending itself."""
    path = F.lower(F.regexp_replace(plain(url), r"^[A-Za-z]+://(?:www\.)?", ""))
    path = F.regexp_replace(path, r"/(?:\d{2,4}x\d{2,4}|w\d{2,4}|thumbs?|large|medium|small|original)(?=/)", "")
    return F.regexp_replace(F.regexp_replace(path, r"\.(?:jpe?g|png|webp|avif|gif)$", ""), r"[-_](?:\d{2,4}x\d{2,4}|w?\d{3,4}w?|thumb|large|medium|small)$", "")


def frame(url: Column) -> Column:
    """The number of a picture in its gallery, as its name states: the last digits before the ending; null without."""
    return F.nullif(F.regexp_extract(plain(url), r"(\d{1,5})\.[A-Za-z]{3,4}$", 1), F.lit("")).try_cast("int")


def picture_by_rules(url: Column, rules: Sequence[tuple[str, str]] = ()) -> Column:
    """The identity of a picture where hosts name theirs: of the first rule whose pattern fits the whole address in lower case, query and all, its template with the pattern's
    groups as $1, $2...; else what `picture` says. So shots that a host serves by query, by rotating folders or under several names are one (E12)."""
    whole, out = F.lower(F.trim(url)), picture(url)
    for pattern, template in reversed(rules):
        out = F.when(whole.rlike(pattern), F.regexp_replace(F.regexp_extract(whole, pattern, 0), pattern, template)).otherwise(out)
    return out


def frame_by_rules(url: Column, rules: Sequence[tuple[str, int]] = ()) -> Column:
    """The place of a picture in its gallery where hosts count theirs: of the first rule whose pattern fits, the number in the pattern's group 1, moved by the rule's offset
    (which sends shots of plates and papers to the end); else what `frame` says (O8)."""
    whole, out = F.lower(F.trim(url)), frame(url)
    for pattern, offset in reversed(rules):
        out = F.when(whole.rlike(pattern), F.nullif(F.regexp_extract(whole, pattern, 1), F.lit("")).try_cast("int") + offset).otherwise(out)
    return out


#: A part of each address that the pattern of junk_picture fits.
JUNK_WORDS = ("data:", "logo", "icon", "sprite", "placeholder", "image", "photo", "blank", "pixel", "avatar", "banner", ".svg", ".gif")


def junk_picture(url: Column) -> Column:
    """Logos, icons, placeholders, pixels and inline data. Null counts as junk."""
    # A search for the words costs far less than the pattern, which is tried at each place of an address.
    may = bound(F.lower(url), lambda x: reduce(or_, (F.contains(x, F.lit(w)) for w in JUNK_WORDS)))
    return F.when(url.isNull(), True).when(may, url.rlike(r"(?i)^data:|(?:^|[/_.-])(?:logo|icon|sprite|placeholder|no[-_]?(?:image|photo)|blank|pixel|avatar|banner)(?:[/_.-]|$)|\.(?:svg|gif)(?:\?|$)")).otherwise(False)
