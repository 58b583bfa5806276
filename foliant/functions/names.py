"""Names and labels of documents, sizes and sessions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as t

# Labels of states and decisions, and their tones.
STATE_LABELS = {"idle": "待机", "running": "执行中", "paused": "已暂停", "completed": "已完成", "cancelled": "已取消", "failed": "失败"}
STATE_TONES = {"completed": "success", "failed": "error", "paused": "warning", "cancelled": "warning"}
DECISION_LABELS = {"proposed": "待处理", "applied": "已应用", "dismissed": "已忽略"}
DECISION_TONES = {"applied": "success", "proposed": "warning", "dismissed": "info"}
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]
UNTITLED = "未命名文稿"


def _mapped(value: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for key, label in table.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def state_label(state: Column) -> Column:
    return _mapped(state, STATE_LABELS, state)


def state_tone(state: Column) -> Column:
    return _mapped(state, STATE_TONES, F.lit("info"))


def decision_label(decision: Column) -> Column:
    return _mapped(decision, DECISION_LABELS, decision)


def decision_tone(decision: Column) -> Column:
    return _mapped(decision, DECISION_TONES, F.lit("info"))


def file_name(name: Column, fallback: str = "result") -> Column:
    """A name without characters that file systems refuse."""
    cleaned = F.regexp_replace(t.trim(name), r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(F.lit(fallback))


def byte_size(n: Column) -> Column:
    """A size in the largest unit that keeps it at 1 or more, with up to two places."""
    x = n.cast("double")
    k = sum(((x >= float(1024**i)).cast("int") for i in range(2, len(BYTE_UNITS))), (x >= 1024.0).cast("int"))
    value = x / F.pow(F.lit(1024.0), k)
    shown = F.when((value >= 100) | (k == 0), F.format_string("%.0f", value)).when(value >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    unit = F.get(F.array(*(F.lit(u) for u in BYTE_UNITS)), k)
    return F.when(F.isnan(x) | (x <= 0) | x.isin(float("inf")) | x.isNull(), "0 B").otherwise(F.concat(shown, F.lit(" "), unit))


def display_path(path: Column) -> Column:
    """A path without the long-path marks of Windows; a blank one as it is."""
    p = t.trim(path)
    out = p
    for mark, instead in (("//?/", ""), ("//?/UNC/", "//"), ("\\\\?\\", ""), ("\\\\?\\UNC\\", "\\\\")):
        out = F.when(F.startswith(p, F.lit(mark)), F.concat(F.lit(instead), F.substr(p, F.lit(len(mark) + 1)))).otherwise(out)
    return F.when(p == "", path).otherwise(out)


def short_hash(text: Column) -> Column:
    """The 32-bit hash 31 * h + unit over the UTF-16 units, its absolute value in hex."""
    units = F.filter(F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G....)"), lambda u: u != "")

    def step(h: Column, unit: Column) -> Column:
        return (h * 31 + F.conv(unit, 16, 10).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))

    signed = lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.lower(F.hex(F.abs(signed(F.aggregate(units, F.lit(0).cast("long"), step)))))


def session_id(path: Column, namespace: bytes) -> Column:
    """The version 5 UUID of a path in a namespace of 16 bytes."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex())), F.encode(path, "UTF-8")))
    part = lambda at, n: F.substr(digest, F.lit(at), F.lit(n))
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def session_title(path: Column) -> Column:
    """The file's name without its last extension."""
    name = F.regexp_extract(F.regexp_replace(path, r"[/\\]+\z", ""), r"([^/\\]*)\z", 1)
    stem = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1)
    return F.when(name.isin("", "..", "."), UNTITLED).when(stem != "", stem).otherwise(name)


def document_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(?s)[^/\\]\.([^./\\]*)\z", 1))
    return F.when(ext.isin("docx", "pdf"), ext).otherwise("text")


def targets_label(ids: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.array_join(ids, ","), F.lit("]")), F.lit("all"))


def is_long(text: Column, limit: int = 6000) -> Column:
    """Whether a unit is long enough to warn of."""
    return t.count_characters(text) >= limit

