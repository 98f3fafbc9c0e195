"""Scalar functions over names, sizes, times, locations and trace lines, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of size text, type names of partition tables, error codes.
UNITS = {"": 1, "B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
MBR_NAMES = {"05": "Extended", "0f": "Extended", "85": "Extended", "07": "NTFS/exFAT", "0b": "FAT32", "0c": "FAT32", "82": "Linux swap", "83": "Linux", "8e": "Linux LVM", "ee": "GPT protective", "ef": "EFI System", "fd": "Linux RAID"}


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def parse_size(text: Column) -> Column:
    """Bytes of "512KiB", "4 MiB", "12"; null for anything else and for what exceeds 63 bits."""
    t = F.trim(text)
    number, unit = F.regexp_extract(t, r"^([0-9]{1,19}) *(B|KiB|MiB|GiB|TiB)?$", 1), F.regexp_extract(t, r"^([0-9]{1,19}) *(B|KiB|MiB|GiB|TiB)?$", 2)
    wide = number.try_cast("decimal(38,0)") * lookup(UNITS, unit).cast("decimal(19,0)")
    return F.when(wide <= F.lit((1 << 63) - 1).cast("decimal(20,0)"), wide.cast("bigint"))


def human_size(n: Column) -> Column:
    """Binary units with one decimal, plain bytes below 1 KiB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit in ("KiB", "MiB", "GiB", "TiB"):
        out = F.when(n >= UNITS[unit], F.format_string(f"%.1f {unit}", n / UNITS[unit])).otherwise(out)
    return out


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"), F.lit(False))


def valid_chunk_size(n: Column) -> Column:
    """A power of two from 256 KiB to 4 MiB."""
    return (n.bitwiseAND(n - 1) == 0) & n.between(256 << 10, 4 << 20)


def split_image(uri: Column) -> tuple[Column, Column, Column]:
    """Destination, set and chain/file of an image location; null with fewer than four parts."""
    p = F.split(uri, "/")
    n = F.size(p)
    ok = n >= 4
    return F.when(ok, F.array_join(F.slice(p, 1, n - 3), "/")), F.when(ok, F.element_at(p, -3)), F.when(ok, F.concat_ws("/", F.element_at(p, -2), F.element_at(p, -1)))


def plain_path(path: Column) -> Column:
    """Whether no part is empty, "." or ".."; the empty path is the root and is plain."""
    return (path == "") | ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))


def created_at(unix: Column) -> Column:
    """Minutes in UTC, or unknown for what no calendar of four-digit years holds."""
    return F.when(unix.between(0, 253_402_300_799), F.concat(F.date_format(F.timestamp_seconds(unix), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))).otherwise("unknown")


def dev_number(major: Column, minor: Column) -> Column:
    return F.shiftleft(major.cast("bigint"), 20).bitwiseOR(minor.cast("bigint"))


def kernel_version(text: Column) -> tuple[Column, Column]:
    """Major and minor of "6.12.96-x"; a missing minor is 0, what is no number is null."""
    p = F.split(F.regexp_extract(text, r"^([^-+]*)", 1), r"\.")
    return p[0].try_cast("int"), F.when(F.size(p) > 1, F.try_element_at(p, F.lit(2)).try_cast("int")).otherwise(0)


def parse_ranges(text: Column) -> Column:
    """"1-5, 9" as array<struct<start, end_incl>>; parts that are no range are null."""
    part = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    one = lambda x: F.when(x.rlike(r"^[0-9]+(-[0-9]+)?$"), F.struct(F.split(x, "-")[0].cast("bigint").alias("start"), F.element_at(F.split(x, "-"), -1).cast("bigint").alias("end_incl")))
    return F.transform(part, one)


def escape_subvolume(path: Column) -> Column:
    bare = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(bare == "", "FS_TREE").otherwise(F.replace(F.replace(bare, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")))


def snapshot_name(path: Column, uuid: Column) -> Column:
    return F.concat(F.substring(escape_subvolume(path), 1, 191), F.lit("."), F.substring(uuid, 1, 8))


def subvolume_options(text: Column) -> tuple[Column, Column]:
    """subvol= and subvolid= of mount options."""
    pick = lambda k: F.regexp_extract(text, rf"(?:^|,){k}=([^,]*)", 1)
    return F.nullif(pick("subvol"), F.lit("")), pick("subvolid").try_cast("bigint")


def mbr_name(code: Column) -> Column:
    return F.coalesce(lookup(MBR_NAMES, F.lower(code)), F.lit("unknown"))


def sector_count(size: Column, block: Column) -> Column:
    return F.call_function("div", size + block - 1, block)


def align_up(n: Column, unit: Column) -> Column:
    return F.call_function("div", n + unit - 1, unit) * unit


def percent(done: Column, total: Column) -> Column:
    """Whole per cent, rounded down; the product is a decimal, as 100 times a count may exceed 64 bits."""
    return F.when(total > 0, F.call_function("div", done.cast("decimal(20,0)") * 100, total.cast("decimal(20,0)")).cast("bigint"))


def keyed_hash(key: str, data: Column) -> Column:
    """Keyed content hash; stands in for a keyed BLAKE3, which Spark lacks."""
    return F.sha2(F.concat(F.lit(key).cast("binary"), data), 256)


def is_zero(data: Column) -> Column:
    """All bytes zero; the empty slice too."""
    return F.length(F.replace(F.hex(data), F.lit("0"), F.lit(""))) == 0


def io_class(flags: Column, sectors: Column) -> Column:
    """What an operation does: ``none`` (no data), ``read``, else ``dirty``. A leading F is a flush mark."""
    bare = F.when(flags.startswith("F") & (F.length(flags) > 1), F.substring(flags, 2, 64)).otherwise(flags)
    return F.when(sectors == 0, "none").when(bare.startswith("R"), "read").otherwise("dirty")


def trace_event(line: Column) -> Column:
    """Struct of a kernel trace line, null for other lines: phase, major, minor, flags, sector, sectors, malformed.

    Completions of no sectors print a sentinel as sector, which becomes 0.
    """
    queue = r"block_bio_queue: *(\d+),(\d+) (\S+) (\d+) \+ (\d+)(?: |$)"
    done = r"block_rq_complete: *(\d+),(\d+) (\S+) \(.*\) (\d+) \+ (\d+)(?: |$)"
    phase = F.when(line.contains("block_bio_queue: "), "queue").when(line.contains("block_rq_complete: "), "complete")
    part = lambda i: F.when(phase == "queue", F.regexp_extract(line, queue, i)).otherwise(F.regexp_extract(line, done, i))
    sectors = part(5).try_cast("bigint")
    sector = F.when(sectors == 0, F.lit(0).cast("bigint")).otherwise(part(4).try_cast("bigint"))
    return F.when(phase.isNotNull(), F.struct(phase.alias("phase"), part(1).try_cast("int").alias("major"), part(2).try_cast("int").alias("minor"), part(3).alias("flags"), sector.alias("sector"), sectors.alias("sectors"), (sectors.isNull() | sector.isNull()).alias("malformed")))


def summary_target(json: Column) -> Column:
    """Where a job's report says its result lies: the first present of three fields."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in ("image_uri", "image_path", "target")])
