"""Names, labels and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Damage label aliases.
DAMAGE_ALIASES = [
    ("crack", "crack"),
    ("wall crack", "crack"),
    ("crack in wall", "crack"),
    ("water damage", "water_damage"),
    ("water stain", "moisture_stain"),
    ("moisture stain", "moisture_stain"),
    ("moisture", "moisture_stain"),
    ("stain", "moisture_stain"),
    ("mold", "mold"),
    ("hole", "hole"),
    ("hole in wall", "hole"),
    ("peel", "peeling_paint"),
    ("peeling paint", "peeling_paint"),
    ("damage", "surface_damage"),
    ("damaged wall", "surface_damage"),
    ("surface damage", "surface_damage"),
]

# Namespace of URL-named identifiers (RFC 4122).
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def slug(value: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(value), "[^a-z0-9_.-]+", "_")
    trimmed = F.regexp_replace(cleaned, "^[_.-]+|[_.-]+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("room"))


def room_label(value: Column) -> Column:
    spaced = F.trim(F.regexp_replace(value, "[_-]+", " "))
    return F.coalesce(F.nullif(F.initcap(spaced), F.lit("")), F.lit("Room"))


def damage_key(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), "[\\s_]+", " "))


def damage_type(label: Column) -> Column:
    """Exact alias lookup; anything else, such as ``water bottle``, stays unknown."""
    aliases = F.create_map(*[F.lit(word) for pair in DAMAGE_ALIASES for word in pair])
    return F.coalesce(F.try_element_at(aliases, damage_key(label)), F.lit("unknown"))


def number_text(value: Column, precision: int, suffix: str) -> Column:
    return F.format_string(f"%.{precision}f {suffix}", value.cast("double"))


def measurement_label(value: Column, lower: Column, upper: Column, level: Column, precision: int = 2,
                      suffix: str = "m", show_confidence: bool = True) -> Column:
    text = number_text(value, precision, suffix)
    if not show_confidence:
        return text
    prefix = F.when(level.isNotNull(), F.concat(F.format_string("%.0f", level * 100.0), F.lit("% CI"))).otherwise("Bounds")
    span = F.format_string(f"%.{precision}f–%.{precision}f {suffix}", lower, upper)
    return F.when(lower.isNotNull() & upper.isNotNull(),
                  F.concat(text, F.lit("\n"), prefix, F.lit(": "), span)).otherwise(text)


def interval_text(lower: Column, upper: Column, unit: Column) -> Column:
    return F.when(lower.isNotNull() & upper.isNotNull(),
                  F.format_string("%.3f–%.3f %s", lower, upper, unit)).otherwise("Unavailable")


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def url_uuid(name: Column) -> Column:
    """Name-based (SHA-1) identifier in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    nibble = F.substring(F.lit("89ab"), (variant % 4 + 1).cast("int"), F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.concat(F.lit("5"), F.substring(digest, 14, 3)),
                       F.concat(nibble, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def first_exif(exif: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(exif, F.lit(name)) for name in names])


def exif_fields(exif: Column) -> dict[str, Column]:
    """Camera fields of a tag map; the capture time comes from the first of two tags."""
    return {
        "camera_make": first_exif(exif, ["Make"]),
        "camera_model": first_exif(exif, ["Model"]),
        "focal_length": first_exif(exif, ["FocalLength"]).try_cast("double"),
        "focal_length_35mm": first_exif(exif, ["FocalLengthIn35mmFilm"]).try_cast("double"),
        "orientation": first_exif(exif, ["Orientation"]).try_cast("int"),
        "timestamp": first_exif(exif, ["DateTimeOriginal", "DateTime"]),
    }
