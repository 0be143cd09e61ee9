"""What to compute: one statistic of one variable, and the rules a request has to keep."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from .functions.calendar import ALIASES, FIXED_MINUTES, FIXED_MONTHS, canonical_word, check_divides

log = logging.getLogger("tidemark")

#: The statistics, and the frequencies a statistic and its output may have.
STATS = ("mean", "sum", "std", "var", "thresh_exceed", "min", "max", "percentile", "raw", "bias_correction", "histogram", "iams")
STAT_FREQS = ("hourly", "2hourly", "3hourly", "6hourly", "12hourly", "daily", "daily_noon", "weekly", "monthly", "3monthly", "yearly", "annually", "10yearly", "10annually", "continuous")
OUTPUT_FREQS = ("hourly", "2hourly", "3hourly", "6hourly", "12hourly", "daily", "daily_noon", "weekly", "monthly", "3monthly", "yearly", "annually", "10yearly", "10annually")
#: Variables whose daily value is a sum rather than a mean.
PRECIPITATION = ("pr", "lsp", "cp", "tp", "pre", "precip", "rain", "precipitation", "precipitationCal")
#: What the engine's own options may be.
CHOICES = {"completeness": ("complete_only", "allow_partial"), "gap_policy": ("error", "warn", "ignore"), "replays": ("drop", "trusted"), "percentile_method": ("exact", "sketch")}
REQUIRED = ("stat", "variable", "time_step", "save", "checkpoint")


@dataclass
class Request:
    stat: str
    variable: str
    time_step: int
    stat_freq: str | None = None
    output_freq: str | None = None
    save: bool = False
    checkpoint: bool = False
    save_filepath: str | None = None
    checkpoint_filepath: str | None = None
    percentile_list: list[float] | None = None
    thresh_exceed: list[float] = field(default_factory=list)
    bins: int | list[float] = 10
    range: tuple[float, float] | None = None
    compression: float = 1
    completeness: str = "complete_only"
    #: What a jump of two steps or more in a series is: error, warn or ignore.
    gap_policy: str = "error"
    #: drop: a key and time counts once; trusted: the caller knows that none is repeated.
    replays: str = "drop"
    #: exact, or sketch: percentiles from a sketch of bounded size.
    percentile_method: str = "exact"
    bias_adjust: bool = False
    ba_reference_dir: str | None = None
    ba_lower_threshold: float | None = None
    ba_non_negative: bool | None = None
    ba_agg_method: str | None = None
    ba_future_method: str | None = None
    ba_future_start_date: str | None = None
    ba_future_weight: float | None = None
    ba_detrend: bool | None = None
    ba_detrend_skip_years: int | None = None

    @property
    def continuous(self) -> bool:
        return self.stat_freq == "continuous"


def _minutes(word: str) -> int:
    word = ALIASES.get(word, word)
    return FIXED_MINUTES.get(word) or FIXED_MONTHS[word] * 43200


def load_request(source: dict | str | Path) -> dict[str, Any]:
    """A mapping, or the path of a YAML file that holds one."""
    if isinstance(source, dict):
        return dict(source)
    if isinstance(source, str | Path):
        import yaml

        with open(source) as file:
            return yaml.safe_load(file)
    raise RuntimeError(f"a request is a mapping or a path, not {type(source).__name__}")


def parse_request(source: dict | str | Path) -> Request:
    """Check a request and fill in its defaults.

    A missing key is a KeyError, a value that isn't supported a ValueError, missing thresholds an
    AttributeError and a wrong type a TypeError; what can be put right is, with a warning.
    """
    given = load_request(source)
    for key in REQUIRED:
        if key not in given:
            raise KeyError(f"the request needs a value for {key!r}")
    if given["stat"] not in STATS:
        raise ValueError(f"stat {given['stat']!r} isn't one of {STATS}")
    names = {f.name for f in fields(Request)}
    request = Request(**{k: v for k, v in given.items() if k in names and v is not None})
    for flag, path in (("save", "save_filepath"), ("checkpoint", "checkpoint_filepath")):
        if not isinstance(given[flag], bool):
            raise ValueError(f"{flag} is True or False")
        if given[flag] and not given.get(path):
            raise KeyError(f"with {flag}, the request needs {path!r}")
        if given[flag] and Path(str(given[path])).suffix:
            log.warning("%s is a folder; the file name is left out", path)
            setattr(request, path, str(Path(str(given[path])).parent))
    if not isinstance(request.time_step, int) or request.time_step <= 0:
        raise ValueError("time_step is a positive number of minutes")
    if request.stat == "raw":
        return request
    if "stat_freq" not in given:
        raise KeyError("the request needs a value for 'stat_freq'")
    if request.stat_freq not in STAT_FREQS:
        raise ValueError(f"stat_freq {request.stat_freq!r} isn't one of {STAT_FREQS}")
    if request.output_freq is None:
        if request.continuous:
            raise ValueError("with continuous, output_freq says when results are given")
        log.warning("output_freq is set to stat_freq")
        request.output_freq = request.stat_freq
    if request.output_freq not in OUTPUT_FREQS:
        raise ValueError(f"output_freq {request.output_freq!r} isn't one of {OUTPUT_FREQS}")
    if not request.continuous:
        request.stat_freq = canonical_word(request.stat_freq)
    request.output_freq = canonical_word(request.output_freq)
    _check_frequencies(request)
    _check_options(request, given)
    return request


def _check_frequencies(request: Request) -> None:
    stat, out = request.stat_freq, request.output_freq
    if request.continuous:
        return
    if stat == "daily_noon" and out == "daily":
        log.warning("output_freq is set to daily_noon")
        request.output_freq = out = "daily_noon"
    if _minutes(out) < _minutes(stat):
        raise ValueError(f"output_freq {out!r} is shorter than stat_freq {stat!r}")
    if stat == "weekly" and out in FIXED_MONTHS:
        raise ValueError("weeks don't fit into months or years")
    if stat in FIXED_MINUTES and out in FIXED_MINUTES and _minutes(out) % _minutes(stat):
        raise ValueError(f"{stat!r} periods don't fit into {out!r} ones")
    if request.stat == "iams" and (stat, out) != ("yearly", "yearly"):
        raise ValueError("iams takes yearly for stat_freq and output_freq")
    if request.stat == "bias_correction" and (stat, out) != ("daily", "daily"):
        raise ValueError("bias_correction takes daily for stat_freq and output_freq")
    check_divides(stat, request.time_step)


def _check_options(request: Request, given: dict[str, Any]) -> None:
    if request.stat == "thresh_exceed":
        if "thresh_exceed" not in given:
            raise AttributeError("thresh_exceed needs its thresholds")
        values = given["thresh_exceed"]
        request.thresh_exceed = list(values) if isinstance(values, list | tuple) else [values]
        if any(isinstance(v, str) for v in request.thresh_exceed):
            raise ValueError("thresholds are numbers")
    if request.stat == "percentile":
        if not request.percentile_list:
            log.warning("percentile_list is set to 0.00 to 0.99")
            request.percentile_list = [i / 100 for i in range(100)]
        if any(isinstance(p, str) or not 0 <= p <= 1 for p in request.percentile_list):
            raise ValueError("percentiles are numbers from 0 to 1")
    if request.stat in ("percentile", "histogram"):
        if "compression" not in given:
            log.warning("compression is set to 1")
        elif isinstance(request.compression, str):
            raise TypeError("compression is a number")
    if request.stat == "histogram" and not isinstance(request.bins, int):
        request.bins = [float(b) for b in request.bins]
        if len(request.bins) < 2 or any(a >= b for a, b in zip(request.bins, request.bins[1:], strict=False)):
            raise ValueError("bins are a number or growing edges")
    if request.range is not None and not (len(request.range) == 2 and request.range[0] <= request.range[1]):
        raise ValueError("range is a lower and an upper limit")
    for name, allowed in CHOICES.items():
        if getattr(request, name) not in allowed:
            raise ValueError(f"{name} is one of {allowed}")
