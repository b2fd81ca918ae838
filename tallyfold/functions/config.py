"""Typed configurations from YAML or JSON files."""

import dataclasses
import json

import typing
from dataclasses import dataclass, field

from tallyfold.errors import ConfigError
from tallyfold.functions.boosting import BoostParams
from tallyfold.operators.ratings import EloParams


@dataclass(frozen=True)
class Elo:
    initial: float = 1500.0
    scale: float = 400.0
    k_provisional: float = 40.0
    k_established: float = 20.0
    provisional_matches: int = 10

    def params(self) -> EloParams:
        return EloParams(self.initial, self.scale, self.k_provisional, self.k_established, self.provisional_matches)


@dataclass(frozen=True)
class Log5:
    prior_wins: float = 5.0
    prior_games: float = 10.0
    half_life_days: float = 540.0


@dataclass(frozen=True)
class Bootstrap:
    n_boot: int = 10_000
    seed: int = 7


@dataclass(frozen=True)
class Harness:
    """What the numbers of a walk-forward run depend on."""

    version: str = "harness"
    seed: int = 7
    elo: Elo = field(default_factory=Elo)
    log5: Log5 = field(default_factory=Log5)
    scored_min_history: int = 3
    calibration_buckets: int = 5
    bootstrap: Bootstrap = field(default_factory=Bootstrap)


@dataclass(frozen=True)
class Logistic:
    c: float = 1.0


@dataclass(frozen=True)
class Boosted:
    max_depth: int = 2
    n_estimators: int = 150
    learning_rate: float = 0.05
    min_child_weight: float = 10.0
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    reg_lambda: float = 2.0
    seed: int = 7

    def params(self, increasing: tuple[int, ...]) -> BoostParams:
        return BoostParams(self.max_depth, self.n_estimators, self.learning_rate, self.min_child_weight, self.subsample, self.colsample_bytree, self.reg_lambda, self.seed, increasing)


@dataclass(frozen=True)
class Models:
    """Hyperparameters of the refitted models."""

    version: str = "models"
    min_train: int = 10
    clip_eps: float = 1e-6
    lr: Logistic = field(default_factory=Logistic)
    xgb: Boosted = field(default_factory=Boosted)
    monotone_increasing: tuple[str, ...] = ("elo_diff", "log5_logit", "h2h_net_wins", "winrate10_diff")


@dataclass(frozen=True)
class Tactical:
    half_life_days: float = 300.0
    min_weighted_strokes: float = 150.0
    min_weighted_serves: float = 30.0
    shrink_strokes: float = 30.0
    shrink_serves: float = 10.0
    long_rally_min: int = 9
    short_rally_max: int = 4


@dataclass(frozen=True)
class Experiment:
    """Feature sets' constants and the contrasts named before results were seen."""

    version: str = "experiment"
    tactical: Tactical = field(default_factory=Tactical)
    contrasts: tuple[tuple[str, str], ...] = (("lr_b", "lr_a"), ("lr_c", "lr_a"), ("lr_a", "elo"), ("lr_b", "elo"), ("xgb_b", "xgb_a"))


def _typed(kind, value, where: str):
    origin = typing.get_origin(kind)
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ConfigError(f"{where or 'the configuration'} must be a mapping")
        hints = typing.get_type_hints(kind)
        if lacking := [f.name for f in dataclasses.fields(kind) if f.name not in value]:
            raise ConfigError(f"{where or 'the configuration'} lacks {lacking}")
        return kind(**{n: _typed(t, value[n], f"{where}.{n}".lstrip(".")) for n, t in hints.items()})
    if origin is tuple:
        args = typing.get_args(kind)
        if not isinstance(value, list | tuple) or (args[-1] is not Ellipsis and len(value) != len(args)):
            raise ConfigError(f"{where} must be a list" + ("" if args[-1] is Ellipsis else f" of {len(args)}"))
        kinds = [args[0]] * len(value) if args[-1] is Ellipsis else args
        return tuple(_typed(k, x, f"{where}[{i}]") for i, (k, x) in enumerate(zip(kinds, value, strict=True)))
    allowed = (int, float) if kind is float else (kind,)
    if isinstance(value, bool) and kind is not bool or not isinstance(value, allowed):
        raise ConfigError(f"{where} must be {kind.__name__}, not {value!r}")
    return kind(value)


def load(path: str, kind: type):
    """The configuration of a class; every field must be there with its type, other keys are ignored."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise ConfigError(f"{path} can't be read: {e.strerror}") from None
    return _typed(kind, read_mapping(text, path), "")


def read_mapping(text: str, path: str = "the text") -> dict:
    """A JSON or YAML mapping."""
    try:
        got = json.loads(text)
    except ValueError:
        import yaml

        try:
            got = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ConfigError(f"{path} is neither JSON nor YAML: {e}") from None
    if not isinstance(got, dict):
        raise ConfigError(f"{path} holds no mapping")
    return got
