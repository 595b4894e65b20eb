"""Channel roles: which header plays which part. Patterns are fixed values, tried case-insensitively."""

from __future__ import annotations

# Role -> patterns; any of them that is found in a header makes it a candidate.
PATTERNS = {
    "time": [r"^time", r"offset", r"elapsed"],
    "rpm": [r"engine\s*speed", r"\brpm\b"],
    "maf_hz": [r"maf.*(freq|hz)", r"\bmaf\s*hz\b", r"mass\s*air\s*flow.*\[\s*hz\s*\]"],
    "maf_gs": [r"maf.*(g\/s|gps|g per|airflow|air flow)", r"mass\s*air\s*flow\b(?!.*\[\s*hz\s*\])"],
    "ltft": [r"ltft", r"long\s*term.*(fuel|trim)"],
    "stft": [r"stft", r"short\s*term.*(fuel|trim)"],
    "ect": [r"\bect\b", r"coolant"],
    "iat": [r"\biat\b", r"intake\s*air\s*temp"],
    "tps": [r"\btps\b", r"throttle\s*position", r"pedal"],
    "map": [r"\bmap\b", r"manifold\s*abs"],
    "load": [r"\bload\b", r"cylinder\s*airmass", r"air\s*mass"],
    "pe": [r"power\s*enrich", r"\bpe\b"],
    "closed_loop": [r"closed.?loop", r"fuel\s*sys", r"\bcl\b"],
    "knock_retard": [r"knock\s*retard", r"\bkr\b"],
    "spark": [r"spark\s*adv", r"ignition\s*timing", r"timing\s*adv"],
    "commanded_afr": [r"commanded.*(afr|equiv|lambda)", r"\beq\s*cmd\b", r"afr.*(cmd|command)", r"target.*(afr|lambda)", r"(equiv|lambda|air-?fuel\s*ratio).*command"],
    "wideband_afr": [
        r"wideband", r"wb.*afr", r"afr.*wide", r"\bafr\b", r"\blambda\b", r"\beq\s*act\b", r"uego", r"\bo2.*wide",
        r"\baem\b", r"afr\s*500", r"innovate", r"\blc-?[12]\b", r"\bmtx-?l\b", r"zeitronix", r"ballenger", r"\bplx\b", r"spartan", r"14\s*point\s*7",
    ],
}
#: Roles that every column that fits plays; all others are played by one.
BANKS = ("ltft", "stft")
#: Roles that are set or not, by a number or a word.
FLAGS = ("pe", "closed_loop")
REQUIRED = ("maf_hz", "ltft", "stft", "ect", "closed_loop", "pe", "tps", "rpm")
