"""Parameters of the pipeline: word lists and numeric settings, overridable by a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

ASPECTS = ("gameplay", "graphics", "story", "controls", "value")

# The keyword lists that decide which sentences speak of an aspect.
ASPECT_KEYWORDS: dict[str, list[str]] = {
    "gameplay": (
        "gameplay,mechanics,playability,fun,boring,engaging,addictive,replay,combat,fighting,shooting,driving,racing,puzzle,strategy,exploration,missions,quests,"
        "levels,difficulty,challenge,skill,learning curve,grind,progression,satisfying,rewarding,repetitive,shallow,deep,immersive,entertaining,enjoyable,frustrating,polished"
    ).split(","),
    "graphics": (
        "graphics,visuals,visual,resolution,fps,framerate,beautiful,stunning,art,animation,animations,textures,rendering,aesthetic,appearance,style,cartoon,realistic,"
        "detailed,blurry,sharp,crisp,lighting,shadows,effects,cutscenes,cinematic,outdated,modern,impressive,gorgeous,smooth"
    ).split(","),
    "story": (
        "story,plot,narrative,character,characters,ending,writing,dialogue,lore,protagonist,villain,heroes,campaign,cutscene,storyline,script,voice acting,acting,immersion,"
        "setting,universe,predictable,twist,emotional,compelling,forgettable,interesting,cliche,original,creative"
    ).split(","),
    "controls": (
        "controls,controller,input,responsive,lag,button,keyboard,mouse,sensitivity,aiming,movement,mobility,handling,physics,clunky,tight,loose,floaty,precise,accurate,"
        "sluggish,mapping,rebind,customizable,joystick,trigger,analog,touchscreen,interface,menu,navigation,camera,targeting"
    ).split(","),
    "value": (
        "price,worth,money,expensive,cheap,value,cost,budget,overpriced,dlc,microtransactions,season pass,content,hours,playtime,replayability,sale,discount,full price,steal,"
        "rip-off,justified,complete,incomplete,short,long,worthwhile,purchase,buy,recommend,regret,satisfied,disappointed"
    ).split(","),
}

# Our own valence lexicon (word, valence -4..4); replaceable through ``Settings.lexicon``.
LEXICON: dict[str, float] = {
    "amazing": 2.8, "annoying": -1.7, "awesome": 3.1, "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "better": 1.9,
    "boring": -1.3, "bored": -1.1, "broken": -2.1, "bug": -1.0, "buggy": -1.8, "charming": 2.8, "clunky": -1.4, "cool": 1.3,
    "cracked": -1.2, "crash": -1.7, "crashes": -1.7, "crisp": 1.1, "cute": 2.0, "damaged": -2.2, "delight": 2.9, "disappointed": -2.1,
    "disappointing": -2.2, "disappoints": -1.9, "dull": -1.7, "easy": 1.9, "enjoy": 2.2, "enjoyable": 2.4, "enjoyed": 2.3, "excellent": 2.7,
    "exciting": 2.2, "fail": -2.5, "fails": -1.8, "fantastic": 2.6, "favorite": 2.0, "favourite": 2.0, "fine": 0.8, "forgettable": -1.2,
    "frustrating": -1.9, "fun": 2.3, "garbage": -2.2, "glad": 2.0, "good": 1.9, "gorgeous": 3.0, "great": 3.1, "happy": 2.7,
    "hate": -2.7, "horrible": -2.5, "impressive": 2.3, "kind": 1.0, "lag": -1.2, "laggy": -1.5, "love": 3.2, "loved": 2.9,
    "lovely": 2.8, "lost": -1.3, "mediocre": -1.1, "nice": 1.8, "overpriced": -1.5, "perfect": 2.7, "pleasant": 2.3, "polished": 1.3,
    "poor": -2.1, "recommend": 1.5, "regret": -1.8, "rewarding": 2.2, "rip-off": -2.6, "sad": -2.1, "satisfying": 2.0, "smooth": 1.2,
    "solid": 1.1, "stunning": 1.6, "surprised": 0.9, "superb": 3.1, "terrible": -2.1, "thanks": 1.9, "trash": -1.9, "ugly": -2.3,
    "unfair": -2.1, "waste": -1.8, "wonderful": 2.7, "worse": -2.1, "worst": -3.1, "worth": 0.9, "wrong": -2.1, "pretty": 2.2,
}

# Fixed values of the published sentiment rules: intensity words and negations.
BOOSTERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "absolutely": 0.293, "incredibly": 0.293, "so": 0.293, "totally": 0.293, "barely": -0.293, "hardly": -0.293, "slightly": -0.293, "somewhat": -0.293, "almost": -0.293}
NEGATIONS = ("not", "no", "never", "none", "nothing", "neither", "nor", "without", "cannot", "can't", "don't", "doesn't", "didn't", "isn't", "wasn't", "won't", "wouldn't", "shouldn't", "aren't", "ain't", "hadn't", "hasn't", "haven't", "couldn't")


@dataclass
class Settings:
    """Numeric settings with the defaults the published pipeline uses."""

    data_dir: str = "data"
    embedding_version: str = "v2"
    min_reviews_per_user: int = 5
    min_reviews_per_item: int = 5
    kcore_passes: int | None = None
    window_share: float = 0.10
    mid_start: float = 0.45
    mid_end: float = 0.55
    window_min_reviews: int = 10
    tfidf_max_features: int = 50_000
    tfidf_min_df: int = 2
    token_budget: int = 512
    dimension: int = 64
    nlist: int = 64
    nprobe: int | None = None  # chosen for the recall
    top_k: int = 200
    recency_lambda: float = 0.01
    tier3_query_weight: float = 0.7
    rounds: int = 50
    depth: int = 5
    patience: int = 5
    seed: int = 42
    lexicon: dict = field(default_factory=lambda: dict(LEXICON))
    aspects: dict = field(default_factory=lambda: dict(ASPECT_KEYWORDS))

    def path(self, name: str) -> str:
        return f"{self.data_dir}/{name}"

    def embedding_path(self, name: str) -> str:
        """One resolver for every stage that reads or writes vectors."""
        return f"{self.data_dir}/embeddings/{self.embedding_version}/{name}"

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def load_settings(path: str | None = None) -> Settings:
    """Defaults, overridden by the keys of a JSON file; unknown keys are refused."""
    if path is None:
        return Settings()
    given = json.loads(Path(path).read_text())
    unknown = set(given) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**given)
