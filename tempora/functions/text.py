"""Scalar text functions: names, types, devices, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.dates import daypart

# Words that mean indoors; activity names as they stand in file names, and what they are called.
INDOOR_WORDS = ["zwift", "peloton", "indoor", "trainer", "stationary"]
ACTIVITIES = [
    "Functional Strength Training", "Traditional Strength Training", "Core Training", "Indoor Cycle", "Outdoor Cycle", "Stationary Bike",
    "Outdoor Run", "Indoor Run", "Trail Run", "Outdoor Walk", "Indoor Walk", "Hiking", "Racewalking",
    "Tennis", "Basketball", "Soccer", "Football", "Baseball", "Volleyball", "Martial Arts", "Boxing",
    "Yoga", "Pilates", "Flexibility", "Tai Chi", "Barre", "HIIT", "CrossFit", "Rowing", "Swimming", "Open Water Swimming",
    "Cooldown", "Stretching", "Meditation", "Other", "Dance", "Elliptical", "Stair Climbing", "Kickboxing", "Disc Golf", "Gymnastics", "Handball",
    "Lacrosse", "Pickleball", "Skiing", "Snowboarding", "Skateboarding", "Surfing", "Wheelchair Walk", "Wheelchair Run",
]
ACTIVITY_ALIASES = {a.lower(): a for a in ACTIVITIES} | {
    "indoor cycling": "Indoor Cycle", "outdoor cycling": "Outdoor Cycle", "indoor walking": "Indoor Walk", "outdoor walking": "Outdoor Walk",
    "indoor running": "Indoor Run", "outdoor running": "Outdoor Run", "trail running": "Trail Run",
}
#: Sport and sub-sport of a device file, and the activity; a null sub-sport is the sport's default.
SPORT_TYPES = [
    ("training", "strength_training", "Traditional Strength Training"), ("training", "functional_training", "Functional Strength Training"),
    ("training", "core", "Core Training"), ("training", None, "Traditional Strength Training"), ("cycling", "indoor_cycling", "Indoor Cycle"),
    ("cycling", "virtual_activity", "Indoor Cycle"), ("cycling", "stationary_bike", "Stationary Bike"), ("cycling", None, "Outdoor Cycle"),
    ("running", "virtual_activity", "Indoor Run"), ("running", "indoor_running", "Indoor Run"), ("running", "trail_run", "Trail Run"),
    ("running", None, "Outdoor Run"), ("walking", "virtual_activity", "Indoor Walk"), ("walking", "indoor_walk", "Indoor Walk"),
    ("walking", None, "Outdoor Walk"), ("walking", "hiking", "Hiking"), ("yoga", None, "Yoga"), ("pilates", None, "Pilates"),
    ("flexibility", None, "Flexibility"), ("swimming", "pool_swimming", "Swimming"), ("swimming", "open_water_swimming", "Open Water Swimming"),
    ("swimming", None, "Swimming"), ("rowing", None, "Rowing"), ("elliptical", None, "Elliptical"),
]


def some(value: Column) -> Column:
    """Null instead of empty text."""
    return F.when(F.trim(value) != "", F.trim(value))


def workout_name(message: Column, source: Column, file_activity: Column, local_start: Column, activity: Column, sport: Column, sub_sport: Column) -> Column:
    """The message's name, the source's, the file's, the part of day with the activity, or what is known, joined by -."""
    known = F.when(activity != "Other", activity)
    built = F.when(known.isNotNull() & local_start.isNotNull(), F.concat_ws(" ", daypart(local_start), known))
    plain = F.concat_ws("-", sport, sub_sport, F.date_format(local_start, "yyyy-MM-dd HH:mm"))
    return F.coalesce(some(message), some(source), some(file_activity), built, some(plain))


def is_indoor(name: Column) -> Column:
    return F.when(some(name).isNotNull(), F.lower(name).rlike("|".join(INDOOR_WORDS)))


def inferred_indoor(distance: Column, gain: Column) -> Column:
    """A workout that goes far without climbing."""
    return (distance > 100) & (F.coalesce(gain, F.lit(0.0)) < 5)


def file_parts(name: Column) -> Column:
    """Date, time, activity and device of YYYY-MM-DD-HHMMSS-Activity-Device.fit or .fit.gz; null if it isn't one.

    The longest activity name that fits wins; blanks and hyphens in it are alike."""
    part = lambda k: F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})-(\d{6})-(.+)\.fit(?:\.gz)?$", k)
    rest, activity, device = part(3), F.lit(None).cast("string"), F.lit(None).cast("string")
    even = F.lower(F.regexp_replace(rest, "-", " "))
    for alias in sorted(ACTIVITY_ALIASES, key=len):  # the last that fits, so the longest, decides
        fits = even.startswith(f"{alias} ") & (F.substring(rest, len(alias) + 1, 1) == "-") & (F.length(rest) > len(alias) + 1)
        activity = F.when(fits, ACTIVITY_ALIASES[alias]).otherwise(activity)
        device = F.when(fits, F.substring(rest, F.lit(len(alias) + 2), F.length(rest))).otherwise(device)
    found = F.struct(part(1).alias("date"), part(2).alias("time"), activity.alias("activity"), device.alias("device"))
    return F.when((rest != "") & activity.isNotNull(), found)


def device_source(name: Column, model: Column) -> Column:
    """Whether a device name or model is a watch's own file or one that a phone passed on."""
    phone = F.coalesce(F.lower(name).contains("iphone"), F.lit(False)) | F.coalesce(F.lower(model).rlike(r"^iphone\d+,\d+"), F.lit(False))
    watch = F.coalesce(F.lower(name).contains("watch"), F.lit(False)) | F.coalesce(F.lower(model).contains("watch"), F.lit(False))
    return F.when(phone, "healthkit_synced").when(watch, "apple_watch").otherwise("unknown")


def activity_from_name(name: Column) -> Column:
    """The activity whose name is part of a title; the longest that fits, and never the catch-all."""
    even = F.lower(F.regexp_replace(name, "-", " "))
    order = sorted((a for a, activity in ACTIVITY_ALIASES.items() if activity != "Other"), key=lambda a: (-len(a), a))
    return F.coalesce(*[F.when(even.contains(a), ACTIVITY_ALIASES[a]) for a in order])


def safe_key(text: Column) -> Column:
    """Text without the characters that a key may not hold."""
    return F.translate(text, "/\\#?\t\n\r", "_______")


def base64url(text: Column) -> Column:
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sport_from_sub(sport: Column, sub_sport: Column) -> Column:
    """A sport that is missing or generic, by the words of its sub-sport."""
    s = F.lower(sub_sport)
    guess = F.when(s.rlike("cycl|bike|ride|spin"), "cycling").when(s.rlike("run|treadmill|track"), "running").when(s.rlike("walk|hik"), "walking").when(s.rlike("swim|water"), "swimming")
    return F.coalesce(F.when(sport != "generic", sport), guess, sport)


def estimated_calories(sport: Column, seconds: Column) -> Column:
    """15 a minute for runs, 10 for the rest, in whole numbers."""
    return (seconds / 60 * F.when(F.lower(sport).contains("run"), 15).otherwise(10)).try_cast("int")


def workout_id(start: Column, sport: Column) -> Column:
    return F.sha1(F.concat_ws("#", start, F.lower(F.trim(sport))))
