"""Classes of free text: title status, losses, condition marks, page or data, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions.numbers import tidy
from vinlake.functions.once import bound

# Fixed values.
_A, _Z = r"(?:^|[^A-Za-z0-9_])", r"(?:$|[^A-Za-z0-9_])"
SALVAGE = rf"salvage[ds]?{_Z}|{_A}slvg{_Z}|{_A}junk{_Z}|non[- ]?repairable|certificate of destruction|{_A}cod{_Z}|{_A}rebuilt{_Z}|parts only|{_A}total[_\s-]*loss{_Z}|전손|총손실|총손"
#: A part of each word that SALVAGE asks for: a text that holds none of them can't fit, and isn't tidied for it.
MAY_BE_SALVAGE = r"(?iu)alvage|slvg|junk|repairable|destruction|cod|rebuilt|parts|total|전손|총손"
ZERO_LOSS = rf"^(?:total[_\s-]*loss(?:\s+from\s+flooding)?|전손|총손실|총손)\s*:\s*0{_Z}"
ZERO_COUNT, SOME_COUNT = rf"total[_\s-]*loss[^:\d]{{0,40}}:\s*0{_Z}", rf"{_A}[1-9][0-9]*{_Z}"
#: Condition marks in the order of their tests; the first that fits decides, and a text that says all is well has none.
WELL = r"NORMAL|GOOD|NONE|N/A|NOT APPLICABLE|ABSENT"
MARKS = (
    ("Z", "Replacement", rf"REPLACEMENT|EXCHANGE|{_A}Z{_Z}|교환"),
    ("W", "Painting/Welding", rf"REPAIR|REPAINT|WELD|PAINT|판금|도장|{_A}W{_Z}"),
    ("R", "Rust", rf"RUST|CORROSION|부식|{_A}R{_Z}"),
    ("C", "Scratch", rf"SCRATCH|흠집|{_A}C{_Z}"),
    ("N", "Unevenness", rf"UNEVEN|DENT|요철|{_A}N{_Z}"),
    ("P", "Damage", rf"DAMAGE|CRACK|BROKEN|손상|깨짐|찌그러|{_A}P{_Z}|DEFECTIVE|불량|SIMPLE"),
)
MARK_RANK = {"Z": 6, "W": 5, "P": 4, "R": 3, "N": 2, "C": 1}
OUTCOMES = ((400, "Invalid VIN"), (401, "Auth / blocked"), (403, "Auth / blocked"), (402, "No credits"), (404, "Not found"), (429, "Rate limited"))


def salvage(raw: Column) -> Column:
    """Whether a text speaks of salvage or a total loss; a count of zero losses doesn't. False for null."""
    speaks = lambda t: t.rlike(f"(?iu){SALVAGE}") & ~zero_losses(t)
    return F.coalesce(F.when(raw.rlike(MAY_BE_SALVAGE), bound(tidy(raw), speaks)), F.lit(False))


def zero_losses(t: Column) -> Column:
    """Whether a text counts zero losses: it begins so, or says so somewhere and holds no other number."""
    return t.rlike(f"(?iu){ZERO_LOSS}") | (t.rlike(f"(?iu){ZERO_COUNT}") & ~t.rlike(SOME_COUNT))


#: How a description states a title, and short forms of loss texts.
TITLE_TEXT = r"(?i)^(?:vehicle title|detailed title|title(?:\s*(?:code|type|status|name))?)\s*:"
LOSS_LABELS = ((r"(?i)^(?:total[_\s-]*loss|전손|총손실|총손)$", "Total loss"), (r"(?i)listed as salvage", "Salvage"), (r"(?i)^salvage record$", "Salvage record"), (r"(?i)^total-?loss record$", "Total loss"))


def said_title(desc: Column) -> Column:
    """The title that a description such as "Title: Clear" states, else null."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(desc), TITLE_TEXT + r"\s*(.+)$", 1)), F.lit(""))


def loss_label(raw: Column) -> Column:
    """A loss text's short form, or what follows "Damage:"; the text itself where there is none."""
    t = F.trim(raw)
    out, rest = t, F.trim(F.regexp_replace(t, r"(?i)^damage:\s*", ""))
    for pattern, label in reversed(LOSS_LABELS):
        out = F.when(t.rlike(pattern), label).otherwise(out)
    of_damage = F.when(rest.rlike(r"(?i)total[_\s-]*loss|전손|총손"), "Total loss").when(rest != "", rest).otherwise(t)
    return F.when(t.rlike(r"(?i)^damage:"), of_damage).otherwise(out)


def title_state(raw: Column) -> Column:
    """The two letters that a title text such as "TX - Salvage" begins with."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(raw), r"^([A-Za-z]{2})\s*[-–—]\s+", 1)), F.lit(""))


def mark(code: Column, raw: Column) -> Column:
    """The condition mark of a panel's result, else null."""

    def of(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for letter, _, pattern in reversed(MARKS):
            out = F.when(t.rlike(pattern), letter).otherwise(out)
        return F.when(~t.rlike(WELL), out)

    return bound(F.upper(F.trim(F.concat_ws(" ", code, raw))), of)


def mark_label(letter: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for a, b, _ in MARKS for x in (a, b))), letter)


def mark_rank(letter: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for x in sum(MARK_RANK.items(), ()))), letter)


def looks_like_page(raw: Column, head: int = 4000) -> Column:
    """Whether a payload is a web page: its beginning tells."""
    return F.coalesce(F.substring(raw, 1, head).rlike(r"(?i)^\s*(?:<!doctype\s+html|<html)|<(?:head|body)[\s>]"), F.lit(False))


def outcome(status: Column) -> Column:
    """Why a request failed, by its status."""
    out = F.when(status >= 500, "Server error").otherwise(F.concat(F.lit("HTTP "), status.cast("string")))
    for code, reason in OUTCOMES:
        out = F.when(status == code, reason).otherwise(out)
    return out


def path_class(path: Column) -> Column:
    return F.when(path.like("%/vin/check/%"), "check").when(path.like("%/v1/vin/%"), "vin").when(path.like("%/v1/live/%"), "live").otherwise("other")


def same_day_text(desc: Column) -> Column:
    """A description as it is compared within a day: marks as spaces, shipment as delivery, automobile as car."""
    low = F.lower(desc)
    t = F.regexp_replace(low, r"[()\[\]{},.;:!?|/\\]+", " ")
    for old, new in ((r"\bshipment\b", "delivery"), (r"\bautomobile\b", "car"), (r"\bdamage to my car\b", "my car damage")):
        t = F.regexp_replace(t, old, new)
    # Without one of those words marks and white space become one space in one pass.
    return F.when(low.rlike("shipment|automobile|damage"), tidy(t)).otherwise(F.trim(F.regexp_replace(low, r"[\s\x{00A0}()\[\]{},.;:!?|/\\]+", " ")))


def poly_hash(text: Column, start: int = 0) -> Column:
    """h * 31 + code over the characters, modulo 2^32."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(start).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))
