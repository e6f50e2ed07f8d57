"""Paths, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions of files that are catalogued.
EXTENSIONS = ("arw", "bmp", "cr2", "cr3", "dng", "gif", "heic", "heif", "jpeg", "jpg", "nef", "orf", "png", "raf", "rw2", "tif", "tiff", "webp")
#: The units of human_bytes.
UNITS = ("B", "KB", "MB", "GB", "TB")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def has_extension(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def hidden_below(path: Column, root: str) -> Column:
    """Whether a part of the path below root starts with a dot."""
    return F.substring(path, len(root.rstrip("/")) + 1, 1 << 30).rlike(r"/\.")


def under(path: Column, root: str) -> Column:
    """Whether path lies below the folder root, with or without its last slash."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/"))


def thumb_path(folder: str, hash_hex: Column) -> Column:
    """Where the thumbnail of a content hash lies: folder/first two digits/hash.jpg."""
    return F.concat_ws("/", F.lit(folder.rstrip("/")), F.substring(hash_hex, 1, 2), F.concat(hash_hex, F.lit(".jpg")))


def one_place(value: Column) -> Column:
    """A double from 0 to 2**53 with one decimal place, rounded by its exact value and halves to even, as C and Rust print it.

    Java's formatter rounds the shortest digits that name the double, and halves up. The part below one is counted in
    2**-56; from 2**-4 on, that is exact.
    """
    whole = F.floor(value)
    tenths = ((value - whole) * 2.0**56).cast("long") * 10
    half = tenths.bitwiseAND(F.lit((1 << 56) - 1))
    down = F.shiftright(tenths, 56)
    up = (half > 1 << 55) | ((half == 1 << 55) & (down % 2 == 1))
    digit = down + F.when(up, 1).otherwise(0)
    return F.concat((whole + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def human_bytes(size: Column, units: tuple[str, ...] = UNITS) -> Column:
    """A byte count in decimal units with one decimal place; bytes have none, and the last unit takes whatever is larger."""
    value = size.cast("double")
    text = F.concat(size.cast("string"), F.lit(f" {units[0]}"))
    for power, unit in enumerate(units[1:], 1):
        text = F.when(value >= 1000.0**power, F.concat(one_place(value / 1000.0**power), F.lit(f" {unit}"))).otherwise(text)
    return text


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def hash_prefix(hash_hex: Column) -> Column:
    """The first six bytes of a hash in hex."""
    return F.substring(hash_hex, 1, 12)


def cluster_hash(hashes: Column) -> Column:
    """SHA-256 of an array of content hashes in order, joined."""
    return F.sha2(F.array_join(F.array_sort(hashes), ""), 256)


def camera_label(make: Column, model: Column) -> Column:
    """Make and model, the make once; blank parts are none; null if nothing is left."""

    def tidy(c: Column) -> Column:
        bare = F.trim(F.regexp_replace(c, "^\\x00+|\\x00+$", ""))
        return F.when(bare != "", bare)

    make, model = tidy(make), tidy(model)
    return F.when(make.isNull() | F.startswith(model, make), F.coalesce(model, make)).otherwise(F.concat_ws(" ", make, model))


def exif_seconds(text: Column) -> Column:
    """Seconds since 1970 of ``YYYY:MM:DD HH:MM:SS``, read as UTC; null if it isn't of that form.

    Days up to 31 are taken in any month and roll over into the next; seconds go up to 60; a two-character field
    may have a sign.
    """
    shape = r"^([+-]?[0-9]{3,4}):([+-][0-9]|[0-9]{2}):([+-][0-9]|[0-9]{2}) ([+-][0-9]|[0-9]{2}):([+-][0-9]|[0-9]{2}):([+-][0-9]|[0-9]{2})$"
    part = [F.try_to_number(F.regexp_replace(F.regexp_extract(text, shape, i), r"^\+", ""), F.lit("S99999")).cast("long") for i in range(1, 7)]
    year, month, day, hour, minute, second = part
    fits = (F.length(text) == 19) & text.rlike(shape) & month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    days = F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))) + day - 1
    return F.when(fits, days * 86400 + hour * 3600 + minute * 60 + second).cast("long")


def eye_facts(faces: Column, open_over: float = 0.18) -> tuple[Column, Column]:
    """(face count, share of open eyes) of an array of faces, each an array of eye boxes (width, height).

    Eyes are open if higher than ``open_over`` of their width; without a measurable eye the share is 0.5, without a
    face 0.
    """
    eyes = F.filter(F.flatten(faces), lambda e: e["width"] > 0)
    count = F.coalesce(F.size(faces), F.lit(0))
    opened = F.size(F.filter(eyes, lambda e: e["height"] / e["width"] > open_over))
    return count, F.when(count == 0, F.lit(0.0)).when(F.size(eyes) > 0, opened / F.size(eyes)).otherwise(F.lit(0.5))


def verdict(reply: Column, members: Column) -> Column:
    """(keeper_index, reason) from a model's reply, bare or fenced; null for anything else.

    The reply must be one JSON object, with nothing around it but white space and fences, that has a whole number
    as keeper_index, in range, and a string as reason.
    """
    bare = F.regexp_replace(reply, r"\A\s+|\s+\z", "")
    inside = F.regexp_replace(F.regexp_replace(bare, "```(?:json)?", ""), r"\A\s+|\s+\z", "")
    body = F.when(F.startswith(bare, F.lit("```")), inside).otherwise(bare)
    json = F.try_parse_json(F.when(F.startswith(body, F.lit("{")) & (F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1), body))
    index, reason = (F.try_variant_get(json, f"$.{k}", "variant") for k in ("keeper_index", "reason"))
    typed = (F.schema_of_variant(index) == "BIGINT") & (F.schema_of_variant(reason) == "STRING")
    got = F.struct(F.try_variant_get(json, "$.keeper_index", "int").alias("keeper_index"), F.try_variant_get(json, "$.reason", "string").alias("reason"))
    return F.when(typed & got["keeper_index"].between(0, members - 1), got)
