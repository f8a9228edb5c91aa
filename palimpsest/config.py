"""Settings of the memory engine in one place; every operator takes a ``Config`` and reads nothing global."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RulePack:
    """Language-dependent patterns, as Java regular expressions."""

    endings: str
    particles: str
    past_reference: str
    ritual: str
    content_word: str
    cardinality_one: tuple[str, ...] = ()
    mutability_high: tuple[str, ...] = ()
    mutability_low: tuple[str, ...] = ()
    standing: tuple[str, ...] = ()


# Patterns and predicates of the Korean rule pack.
KOREAN = RulePack(
    endings="(었|았|였|겠|시|으)?(다|는|은|을|던|서|고|며|지|나|냐|어|아|여|요|음|기|게|니|까|습니다|합니다|했|한|할|해)$",
    particles="(으로서|으로써|에게서|한테서|으로|에서|에게|한테|께서|부터|까지|이|가|은|는|을|를|에|의|와|과|도|만|로|께|랑|이랑)$",
    past_reference="(기억|그때|저번|예전|아까|전에|했잖아|말했|뭐였|언제)",
    ritual="^(응|ㅇㅇ|ㅋ+|어|그래|넵|왜|뭐)$",
    content_word="[가-힣]{2,}",
    cardinality_one=("직업", "거주지", "반려동물_이름"),
    mutability_high=("직업", "거주지", "일상_사소"),
    mutability_low=("신체_특성", "가족", "반려동물_이름", "지인_반려동물"),
    standing=("직업", "거주지", "반려동물_이름", "신체_특성", "가족", "선호", "지인_반려동물", "지인_직업", "관계_배경"),
)

# A rule pack whose patterns occur in the bundled tables.
LATIN = RulePack(
    endings="(tion|ing|ment|ción|heit|keit|ung|ed|es|er|ly|nt|eau)$",
    particles="(the|and|el|la|le|en|s)$",
    past_reference="(?i)(was|were|that|what|which|que|nicht)",
    ritual="^(?i)(the|and|to|is|it|of)[.!?]?$",
    content_word="[A-Za-z]{2,}",
    cardinality_one=("purchase", "signup", "view"),
    mutability_high=("view",),
    mutability_low=("signup",),
    standing=("purchase", "signup", "click"),
)


@dataclass(frozen=True)
class Config:
    pack: RulePack = LATIN
    importance_gate: float = 0.2
    relevance_cut: float = 0.05
    top_k: int = 5
    window_turns: int = 10
    window_chunk: int = 10
    surfaced_penalty: float = 0.1
    relevance_weight: float = 0.6
    importance_weight: float = 0.4
    min_evidence: int = 3
    dedup_window: int = 20
    dedup_jaccard: float = 0.6
    confidence_floor: float = 0.6
    reinforce: float = 0.05
    tolerance: dict[str, float] = field(default_factory=lambda: {"high": 0.25, "mid": 0.10, "low": -0.05})
    backoff: tuple[int, int, int] = (1, 3, 7)
    session_turns: int = 30
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    min_utterance: int = 8
    budget: int = 4000
    fixed_blocks: int = 1370
    depths: tuple[tuple[int, float], ...] = ((5, 0.75), (30, 0.20), (300, 0.05))
    price_in: float = 0.75
    price_cached: float = 0.075
    price_out: float = 3.75
    output_tokens: int = 400
    turns_per_month: int = 10_000


DEFAULT = Config()
