"""Queries of the core's data-processing problems over the test tables, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterkit.operators.packed import split_names, split_packed
from platterkit.operators.snapshots import collection_changes
from platterkit.operators.units import feed_units, stated_seconds
from platterkit.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that state a positive length otherwise than in the common form, in seconds."""
    return stated_seconds(read(spark, d, "tracks"), read(spark, d, "release_videos"), read(spark, d, "feeds")).select("src", "rec_id", "seconds")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of credit references and artist names that pack two or more."""
    credits = split_packed(read(spark, d, "release_credits"), "id", "tracks")
    names = split_names(read(spark, d, "releases"), "id", "artist_names", read(spark, d, "artists"), "name")
    one = lambda src, df: df.select(F.lit(src).alias("src"), F.col("id").alias("rec_id"), "pos", "item")
    return one("release_credits", credits).unionByName(one("releases", names))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Releases added, removed or changed between consecutive snapshots."""
    return collection_changes(read(spark, d, "collection_snapshots"))


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """The unit of each feed and period, where it comes from, and whether the residuals settle it and agree with the note."""
    units = feed_units(read(spark, d, "tracks"), read(spark, d, "release_videos"), read(spark, d, "feeds"))
    return units.select("src", "feed", F.col("start_us").isNotNull().alias("later"), "unit", "unit_from", "is_unique", "agrees")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_units": p1_units, "p2_found": p2_found, "p7_found": p7_found}

# The SQL knows the notes of the test tables only, finds silent feeds' units by medians alone, and reads wording as numbers with the first letter of what follows them.
_PARTS = """list_sum(list_transform(regexp_extract_all(u, '[0-9]+(?:[.,][0-9]+)? *[^0-9 ,.]*'), lambda x, i: replace(regexp_extract(x, '^[0-9.,]+'), ',', '.')::double * case
  when trim(regexp_extract(x, '[^0-9., ]*$')) = '' then case when i > 1 then 1 end when regexp_matches(x, '[0-9] *(h|std)') then 3600 when regexp_matches(x, '[0-9] *(s|"|″|”|'''')') then 1 when regexp_matches(x, '[0-9] *(m|''|′|’)') then 60 end))"""
_WORDED = f"""case when regexp_matches(u, 'sa?mp') then regexp_extract(u, '^[0-9]+')::double / (regexp_extract(u, '([0-9.]+) k?hz', 1)::double * case when contains(u, 'khz') then 1000 else 1 end)
  when contains(u, 'frames (') then regexp_extract(u, '^[0-9]+')::double / regexp_extract(u, '\\(([0-9]+)', 1)::double
  when regexp_matches(u, '(ms|msec|milliseconds)$') then regexp_replace(u, '[^0-9]', '', 'g')::double / 1000
  when regexp_matches(u, '[0-9]:[0-9]') then list_reduce(list_transform(string_split(regexp_extract(u, '[0-9]+(:[0-9.]+)+'), ':'), lambda x: x::double), lambda a, x: a * 60 + x)
  when regexp_matches(u, 'rpm|inch|bit|take') then null else {_PARTS} end"""
_UNITS = "('millisecond', 0.001::double), ('frame_75', 1 / 75::double), ('frame_30', 1 / 30::double), ('frame_25', 0.04::double), ('hundredth', 0.01::double), ('tenth', 0.1::double), ('second', 1::double), ('minute', 60::double), ('clock', 60::double), ('hour', 3600::double)"
_LENGTHS = f"""
with rec as (select 'tracks' src, id rec_id, feed, recorded_at, trim(duration) t from tracks union all select 'release_videos', id, feed, recorded_at, trim(duration::varchar) from release_videos),
kinds as (select *, lower(t) u, regexp_matches(t, '^\\d+(:\\d+){{1,2}}$') common, case when regexp_matches(t, '^\\d+([.,]\\d+)?$') then replace(t, ',', '.')::double end num from rec where t <> ''),
said as (select *, case when common then list_reduce(list_transform(string_split(t, ':'), lambda x: x::double), lambda a, x: a * 60 + x) when num is null then {_WORDED} end secs from kinds),
parts as (select delivers src, feed, unnest(string_split_regex(lower(note), 'from 1 april 2024|since 2024-04-01t00:00z')) p, generate_subscripts(string_split_regex(lower(note), 'from 1 april 2024|since 2024-04-01t00:00z'), 1) i,
  len(string_split_regex(lower(note), 'from 1 april 2024|since 2024-04-01t00:00z')) n from feeds),
noted as (select src, feed, case when n > 1 and i = 2 then timestamp '2024-04-01' end lo, case when n > 1 and i = 1 then timestamp '2024-04-01' end hi,
  case when p like '%milli%' then 'millisecond' when p like '%tenth%' then 'tenth' when p like '%sectors%' then 'frame_75' when p like '%25 frames%' then 'frame_25' when p like '%two digits%' then 'clock' when p like '%minut%' then 'minute' when p like '%second%' then 'second' end unit from parts),
silent as (select delivers src, feed from feeds where (delivers, feed) not in (select src, feed from noted where unit is not null)),
typical as (select median(ln(secs)) m from said where secs > 0),
guessed as (select src, feed, arg_min(unit, abs(x + ln(factor) - m)) unit from (select src, feed, median(ln(num)) x from said join silent using (src, feed) where num > 0 group by all), typical, (values {_UNITS}) u(unit, factor) where unit not in ('clock', 'minute') group by 1, 2),
units as (select src, feed, lo, hi, unit from noted where unit is not null union all select src, feed, null, null, unit from guessed),
found as (select src, rec_id, secs s from said where not common and num is null and secs > 0
 union all select r.src, rec_id, case when u.unit = 'clock' then floor(num) * 60 + coalesce(try_cast(rpad(regexp_extract(t, '[.,](\\d{{1,2}})', 1), 2, '0') as double), 0) else num * factor end
 from said r join units u on u.src = r.src and u.feed = r.feed and (lo is null or recorded_at >= lo) and (hi is null or recorded_at < hi) join (values {_UNITS}) f(unit, factor) on f.unit = u.unit
 where num > 0 and not (r.src = 'release_videos' and u.unit = 'second'))
"""

ORACLES: dict[str, str] = {
    "p1_units": _LENGTHS + "select src, feed, lo is not null later, unit, case when (src, feed) in (select src, feed from silent) then 'residuals' else 'note' end unit_from, true is_unique, true agrees from units",
    "p1_found": _LENGTHS + "select distinct src, rec_id, floor(s + 0.5)::bigint as seconds from found",
    "p7_found": r"""
with valid as (
  select snapshot_no, id, arg_max(struct_pack(
           t := trim(title), y := year, g := list_sort(list_distinct(genres)),
           d := case when regexp_matches(date_added, '(Z|[+-]\d\d:?\d\d)$') then epoch_us(date_added::timestamptz) else epoch_us(date_added::timestamp) end,
           here := removed_from_discogs_at is null or removed_from_discogs_at > snapshot_at), delivered_at) s
  from collection_snapshots group by 1, 2),
present as (select snapshot_no, id, struct_pack(t := s.t, y := s.y, g := s.g, d := s.d) v from valid where s.here),
nos as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) prev from (select distinct snapshot_no from collection_snapshots)),
cur as (select n.snapshot_no, p.id, p.v from nos n join present p on p.snapshot_no = n.snapshot_no where n.prev is not null),
bef as (select n.snapshot_no, p.id, p.v from nos n join present p on p.snapshot_no = n.prev)
select coalesce(c.snapshot_no, b.snapshot_no) snapshot_no, coalesce(c.id, b.id) release_id,
       case when b.id is null then 'added' when c.id is null then 'removed' else 'changed' end as change
from cur c full join bef b on c.snapshot_no = b.snapshot_no and c.id = b.id
where b.id is null or c.id is null or c.v is distinct from b.v
""",
}
