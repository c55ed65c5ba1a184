"""Names of format versions, database states, page flags and tag flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import col

# Fixed values: (version, revision) of the known formats, in the order in which the labels sort; matches are exact.
FINGERPRINTS = {
    (0x623, 0x00): "NewSpaceManager",
    (0x620, 0x00): "OriginalOperatingSystemBetaFormat",
    (0x620, 0x09): "WindowsXPSP3",
    (0x620, 0x0B): "ExchangeWithEcc",
    (0x620, 0x0C): "WindowsVista",
    (0x620, 0x11): "Windows7SP0",
    (0x620, 0x14): "Exchange2013Ad2016",
    (0x620, 0xC8): "Windows11_21H2",
    (0x620, 0xE6): "Windows11",
}
#: Order of the labels, as their codes sort.
FINGERPRINT_CODES = {name: i for i, name in enumerate([*FINGERPRINTS.values(), "Other"])}
# Database states.
STATES = {1: "JustCreated", 2: "DirtyShutdown", 3: "CleanShutdown", 4: "BeingConverted", 5: "ForceDetach"}
# Bits of a page's flags.
PAGE_FLAGS = {"Root": 0x1, "Leaf": 0x2, "Parent": 0x4, "Empty": 0x8, "SpaceTree": 0x20, "Index": 0x40, "LongValue": 0x80, "Erased": 0x4000, "Repaired": 0x200000}
#: Those that page_flag_labels() names, in its order.
NAMED_FLAGS = ("Root", "Leaf", "LongValue", "Empty", "Index", "Parent", "SpaceTree")
#: A page with none of these is a branch.
NOT_BRANCH = PAGE_FLAGS["Root"] | PAGE_FLAGS["Leaf"] | PAGE_FLAGS["Index"] | PAGE_FLAGS["SpaceTree"] | PAGE_FLAGS["LongValue"]
# Bits of a tag's flags.
TAG_FLAGS = {"VariableSize": 1, "Defunct": 2, "CommonKey": 4}
DEFAULT_STATE, DEFAULT_FINGERPRINT = "Unknown", "Exchange2013Ad2016"


def _choose(cases: list[tuple[Column, str]], other: str) -> Column:
    out = F.lit(other)
    for condition, label in reversed(cases):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def fingerprint(version: Column | str, revision: Column | str) -> Column:
    return _choose([((col(version) == v) & (col(revision) == r), name) for (v, r), name in FINGERPRINTS.items()], "Other")


def fingerprint_code(version: Column | str, revision: Column | str) -> Column:
    label = fingerprint(version, revision)
    out = F.lit(FINGERPRINT_CODES["Other"])
    for name, code in FINGERPRINT_CODES.items():
        out = F.when(label == name, F.lit(code)).otherwise(out)
    return out


def state(code: Column | str) -> Column:
    return _choose([(col(code) == c, name) for c, name in STATES.items()], DEFAULT_STATE)


def state_code(code: Column | str) -> Column:
    """States in the order of their codes, Unknown last."""
    return F.when(col(code).between(1, 5), col(code).cast("int")).otherwise(F.lit(6))


def has_flag(flags: Column | str, name: str) -> Column:
    return col(flags).bitwiseAND(F.lit(PAGE_FLAGS[name]).cast("long")) > 0


def is_branch(flags: Column | str) -> Column:
    return col(flags).bitwiseAND(F.lit(NOT_BRANCH).cast("long")) == 0


def page_flag_labels(flags: Column | str) -> Column:
    return F.array_compact(F.array(*(F.when(has_flag(flags, name), F.lit(name)) for name in NAMED_FLAGS)))


def tag_flag_labels(flags: Column | str) -> Column:
    return F.array_compact(F.array(*(F.when(col(flags).bitwiseAND(bit) > 0, F.lit(name)) for name, bit in TAG_FLAGS.items())))
