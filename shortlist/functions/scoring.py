"""Scoring rules as column expressions, plus the driver-side criteria parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist.functions.text import strip_ws

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------
WEIGHT_SEMANTIC = 0.55
WEIGHT_EXPERIENCE = 0.20
WEIGHT_SKILLS = 0.25
SCORE_DECIMALS = 4
LOW_QUANTILE = 0.40
HIGH_QUANTILE = 0.75
THRESHOLD_DECIMALS = 6
LABELS = ("High", "Medium", "Low")
STRONG_SEMANTIC = 0.75
MODERATE_SEMANTIC = 0.55
STRONG_PHRASE = "strong semantic alignment with the job description"
MODERATE_PHRASE = "moderate semantic alignment"
EXPERIENCE_PHRASE = "{} years of relevant experience"
SKILLS_PHRASE = "matches skills: {}"
REASON_PREFIX = "Selected because of: "
REASON_JOIN = "; "
BASELINE_REASON = "Baseline match"
REASON_MAX_SKILLS = 5
DEFAULT_TOP_N = 5
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_skills(items: Sequence[str]) -> tuple[list[str], list[str]]:
    """Criteria skills → (required, mandatory), driver side.

    Each item is stripped; '!' marks it mandatory (the rest is stripped again)
    and a mandatory skill is also required.  Order, spelling and duplicates
    are kept.
    """
    stripped = [s.strip() for s in items]
    names = [s[1:].strip() if s.startswith("!") else s for s in stripped]
    mandatory = [n for s, n in zip(stripped, names) if s.startswith("!")]
    return names, mandatory


@dataclass(frozen=True)
class Criteria:
    """One ranking query (the job criteria)."""

    job_description: str = ""
    top_n: int = DEFAULT_TOP_N
    min_exp: int = 0
    skills: tuple[str, ...] = field(default_factory=tuple)
    jd_id: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "skills", tuple(self.skills))
        if self.top_n < 0:
            raise ValueError("top_n must be >= 0")

    @property
    def required(self) -> list[str]:
        return split_skills(self.skills)[0]

    @property
    def mandatory(self) -> list[str]:
        return split_skills(self.skills)[1]

    @property
    def required_set(self) -> list[str]:
        """Lower-cased, de-duplicated required skills (first-seen order)."""
        return list(dict.fromkeys(s.lower() for s in self.required))

    @property
    def mandatory_set(self) -> list[str]:
        return list(dict.fromkeys(s.lower() for s in self.mandatory))


def _str_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def experience_score(years: Column | str, min_exp: int | Column) -> Column:
    """0 below the minimum, else (years - min + 1) / 10 capped at 1."""
    y = _col(years)
    m = min_exp if isinstance(min_exp, Column) else F.lit(int(min_exp))
    return F.when(y < m, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (y.cast("double") - m + 1) / F.lit(10.0)))


def passes_mandatory(candidate: Column | str, mandatory: Sequence[str]) -> Column:
    """Relational division: the candidate has every mandatory skill."""
    mand = list(dict.fromkeys(s.lower() for s in mandatory))
    if not mand:
        return F.lit(True)
    return F.size(F.array_except(_str_array(mand), _col(candidate))) == 0


def skills_score(candidate: Column | str, required: Sequence[str],
                 mandatory: Sequence[str]) -> Column:
    """Share of required skills the candidate has; 0 if a mandatory one is missing.

    ``candidate`` is the lower-cased, non-blank skill array of a row.
    """
    req = list(dict.fromkeys(s.lower() for s in required))
    ok = passes_mandatory(candidate, mandatory)
    if not req:
        share = F.lit(1.0)
    else:
        share = F.size(F.array_intersect(_str_array(req), _col(candidate))) / F.lit(float(len(req)))
    return F.when(ok, share).otherwise(F.lit(0.0))


def round_half_even(x: Column, decimals: int) -> Column:
    """numpy-style rounding: scale, round half to even, unscale."""
    scale = float(10 ** decimals)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def final_score(semantic: Column | str, exp_score: Column | str, skill_score: Column | str) -> Column:
    """Weighted sum rounded to 4 decimals (half to even, as numpy does)."""
    total = (F.lit(WEIGHT_SEMANTIC) * _col(semantic)
             + F.lit(WEIGHT_EXPERIENCE) * _col(exp_score)
             + F.lit(WEIGHT_SKILLS) * _col(skill_score))
    return round_half_even(total, SCORE_DECIMALS)


def label(score: Column | str, low: Column | float, high: Column | float) -> Column:
    """High at or above ``high``, Medium at or above ``low``, else Low."""
    s = _col(score)
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return (F.when(s >= hi, F.lit(LABELS[0]))
             .when(s >= lo, F.lit(LABELS[1]))
             .otherwise(F.lit(LABELS[2])))


def reason(semantic: Column | str, exp_years: Column | str, skills_list: Column | str,
           requested: Sequence[str] | Column) -> Column:
    """Human-readable reason: semantic band, years, and matched requested skills (a list or an array column).

    Matched skills keep the request's order, spelling and duplicates; the
    candidate set here keeps blank tokens (only stripped and lower-cased).
    """
    sem = _col(semantic)
    years = _col(exp_years)
    sem_part = (F.when(sem >= STRONG_SEMANTIC, F.lit(STRONG_PHRASE))
                 .when(sem >= MODERATE_SEMANTIC, F.lit(MODERATE_PHRASE)))
    exp_part = F.when(years > 0, F.format_string(EXPERIENCE_PHRASE.replace("{}", "%s"),
                                                  years.cast("string")))
    parts = [sem_part, exp_part]
    if isinstance(requested, Column) or requested:
        wanted = requested if isinstance(requested, Column) else _str_array(list(requested))
        cand = F.transform(F.split(_col(skills_list), ","), lambda s: F.lower(strip_ws(s)))
        matched = F.filter(wanted,
                           lambda s: F.array_contains(cand, F.lower(s)))
        first = F.slice(matched, 1, REASON_MAX_SKILLS)
        parts.append(F.when(F.size(matched) > 0,
                            F.format_string(SKILLS_PHRASE.replace("{}", "%s"),
                                            F.array_join(first, ", "))))
    present = F.array_compact(F.array(*parts))
    return F.when(F.size(present) > 0,
                  F.concat(F.lit(REASON_PREFIX), F.array_join(present, REASON_JOIN))) \
            .otherwise(F.lit(BASELINE_REASON))


def percent_text(ratio: Column | str, decimals: int = 1) -> Column:
    """A ratio as display text, e.g. 0.9876 → '98.8%'."""
    return F.format_string(f"%.{int(decimals)}f%%", _col(ratio) * F.lit(100.0))


def title_text(name: Column | str) -> Column:
    """A snake_case name as a title, e.g. 'score_distribution' → 'Score Distribution'."""
    return F.initcap(F.replace(_col(name), F.lit("_"), F.lit(" ")))
