"""Settings that change results. All are immutable and checked on construction."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

FIELD_SEPARATOR = "<|field_sep|>"
DOC_SEPARATOR = "<|endoftext|>"
DOC_SEPARATOR_TYPO = "<|endofext|>"

STOP_WORDS = frozenset(
    "a an and are as at be by else for from has he how if in is it its not of on or "
    "that the then these this those to was were what when where which who why will with".split()
)
_RUN = "[a-z0-9]+"
WORD = f"{_RUN}(?:'{_RUN})?"

_NUMERAL, _BETWEEN, _LETTER, _ORDINAL = "i{1,4}", "[^a-z0-9]+", "[a-d]", "(?:i{1,4}|[1-4])"
_TRUTH = "(?:true|false)"


def _near(one: str, other: str, most: int = 2) -> str:
    """Two words with at most so many words between them."""
    return rf"\b{one}(?:\s+\w+){{0,{most}}}\s+{other}\b"


def _phrase(*words: str) -> str:
    return r"\b" + r"\s+".join(words) + r"\b"


#: Windows of answer-sheet phrasing; their order numbers them in build statistics.
REJECT = (
    rf"\b{_NUMERAL}\b{_BETWEEN}only\b",
    rf"\b{_NUMERAL}\b{_BETWEEN}(?:or|and){_BETWEEN}\b{_NUMERAL}\b",
    rf"\boptions?\s*{_LETTER}\b",
    rf"\banswers?\s*:\s*{_LETTER}\b",
    _near("which", "following"),
    _near("select", "(?:option|answer)"),
    _near("(?:all|none)", "above"),
    rf"\bboth\s+{_LETTER}\s+(?:and\s+)?{_LETTER}\b",
    rf"\b{_TRUTH}\b(?:\W+{_TRUTH}){{2,}}",
    rf"\b{_LETTER}\b{_BETWEEN}{_ORDINAL}\b{_BETWEEN}(?:only|{_TRUTH})\b",
    rf"\b{_LETTER}\)\s*{_ORDINAL}\b",
    rf"\(\s*{_ORDINAL}\s*\)\s*(?:or|and)\s*\(\s*{_ORDINAL}\s*\)",
    _near(r"correct\s+answer", "is"),
    r"\blogically\s+equivalent\b.*\bcontradictory\b",
    r"\bneither\b.*\bnor\b.*\bconsistent\b",
    _phrase("find", "value", "x"),
    r"\bsolve\s+(?:for\s+)?x\b",
    _phrase("simplify", "expression"),
    r"\bremainder\s+\w*\s+divided\b",
    _phrase("what", "probability"),
    _phrase("compute", "(?:difference|product|quotient|sum)"),
    _phrase("equation", "(?:circle|line|parabola)"),
    r"\bif\s+(?:and\s+)?only\s+if\b",
    rf"\bstatements?\b.*\b{_TRUTH}\b",
    r"\bwhich\s+statements?\b.*\btrue\b",
    _near("according", "passage"),
)
#: Words one of which any match of REJECT in a window of tokens has to contain
#: (patterns with a colon or parenthesis can't match tokens at all).
REJECT_TRIGGERS = frozenset(
    "above according and both compute correct equation false if logically neither only or remainder select simplify solve "
    "statement statements true value what which".split()
)
REJECT_TRIGGER_PREFIX = "option"


@dataclass(frozen=True)
class Normalization:
    """How texts become tokens and which windows count."""

    stop_words: frozenset[str] = STOP_WORDS
    word: str = WORD
    reject: tuple[str, ...] = REJECT
    nfkc: bool = True

    @property
    def is_default(self) -> bool:
        return self.word == WORD and self.reject == REJECT and self.nfkc

    def as_json(self) -> str:
        return json.dumps([sorted(self.stop_words), self.word, list(self.reject), self.nfkc])

    def fingerprint(self) -> str:
        return hashlib.blake2b(self.as_json().encode(), digest_size=32).hexdigest()

    def sha256(self) -> str:
        return hashlib.sha256(self.as_json().encode()).hexdigest()


@dataclass(frozen=True)
class ScanConfig:
    text_keys: tuple[str, ...] = ()
    messages_key: str | None = None
    id_key: str | None = "id"
    ngram: int = 13
    min_hits: int = 3
    min_coverage: float = 0.001
    gate_mode: str = "union"
    min_longest_run: int = 0
    boilerplate_threshold: int = 50
    min_item_coverage: float = 0.0
    packed_doc_sep: str | None = DOC_SEPARATOR
    packed_doc_sep_typo: str | None = DOC_SEPARATOR_TYPO
    max_return_records: int | None = 500
    spaced: bool = False
    spaced_min_loci: int = 3
    spaced_ver_min_span: int = 17
    spaced_ver_identity: float = 0.85
    exact_min_chars: int = 12
    confirm: bool = False
    exact_channel: str = "off"
    normalization: Normalization = field(default_factory=Normalization)

    def __post_init__(self) -> None:
        if not self.text_keys and self.messages_key is None:
            object.__setattr__(self, "text_keys", ("text",))
        if self.gate_mode == "auto":
            object.__setattr__(self, "gate_mode", "union")
        for ok, what in (
            (self.ngram >= 1, "ngram has to be positive"),
            (self.min_hits >= 1, "min_hits has to be positive"),
            (0 <= self.min_coverage <= 1, "min_coverage lies between 0 and 1"),
            (0 <= self.min_item_coverage <= 1, "min_item_coverage lies between 0 and 1"),
            (self.gate_mode in ("union", "item"), "gate_mode is union, item or auto"),
            (self.min_longest_run >= 0, "min_longest_run can't be negative"),
            (self.boilerplate_threshold >= 2, "boilerplate_threshold is at least 2"),
            (self.exact_channel in ("off", "short", "all"), "exact_channel is off, short or all"),
            (self.spaced_min_loci >= 1 and self.spaced_ver_min_span >= 1, "spaced limits have to be positive"),
            (0 < self.spaced_ver_identity <= 1, "spaced_ver_identity lies above 0, at most 1"),
        ):
            if not ok:
                raise ValueError(what)

    def fingerprint(self) -> str:
        """Of what changes results; paths and parallelism are no part of it."""
        body = asdict(self) | {"normalization": self.normalization.fingerprint()}
        return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class BenchmarkSpec:
    """A protected benchmark: where it is and which fields are protected.

    path is a file, a folder or a glob; with configs, a folder of `<config>/<split>*`.
    revision is a string of provenance: nothing is downloaded.
    """

    name: str
    path: str
    fields: tuple[str, ...]
    format: str = "parquet"
    splits: tuple[str, ...] = ("test",)
    revision: str | None = None
    subtract: tuple[str, ...] = ()  # paths of splits whose n-grams don't count
    label_field: str | None = None
    dataset: str | None = None
    configs: tuple[str, ...] = ()  # ("*",): every folder below path
    drop_configs: tuple[str, ...] = ()
    data_files: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for ok, what in (
            (self.name.strip(), "a benchmark needs a name"),
            (self.fields and all(f.strip() for f in self.fields), f"{self.name}: fields have to be named"),
            (self.splits and all(x.strip() for x in self.splits), f"{self.name}: splits have to be named"),
            (self.format in ("parquet", "json", "jsonl", "csv"), f"{self.name}: format is parquet, json, jsonl or csv"),
            (self.label_field is None or self.label_field.strip(), f"{self.name}: label_field can't be blank"),
        ):
            if not ok:
                raise ValueError(what)


@dataclass(frozen=True)
class ItemStopGrams:
    max_item_share: float = 1.0
    min_count: int = 0
