"""How nodes and links are drawn: colours, strokes, forces, and where arrows stand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph.functions.scalars import node_radius

#: Colours by level and by sentiment, strokes by sentiment.
LEVEL_COLOURS = {0: "#3b82f6", 1: "#10b981", 2: "#f59e0b", 3: "#ef4444"}
OTHER_LEVEL = "#64748b"
ONE_WAY = "#ef4444"
SENTIMENT_COLOURS = {"positive": "#10b981", "neutral": "#94a3b8", "negative": "#ef4444"}
OTHER_SENTIMENT = "#94a3b8"
SENTIMENT_STROKES = {"positive": "solid", "neutral": "dotted", "negative": "dashed"}
ARROW_OFFSET = 12


def _chosen(key: Column, values: dict, other: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(pairs[key], F.lit(other))


def level_colour(level: Column) -> Column:
    return _chosen(level, LEVEL_COLOURS, OTHER_LEVEL)


def sentiment_colour(sentiment: Column) -> Column:
    return _chosen(sentiment, SENTIMENT_COLOURS, OTHER_SENTIMENT)


def sentiment_stroke(sentiment: Column) -> Column:
    return _chosen(sentiment, SENTIMENT_STROKES, "solid")


def vouch_colour(level: Column, reciprocal: Column) -> Column:
    return F.when(reciprocal, level_colour(level)).otherwise(ONE_WAY)


def vouch_opacity(reciprocal: Column) -> Column:
    return F.when(reciprocal, F.lit(0.7)).otherwise(F.lit(0.5))


def faded(base: float, target_level: Column) -> Column:
    """Opacity of a link by the level of its target."""
    return F.lit(base) + (F.lit(1.0) - F.lit(0.1) * target_level)


def thinned(base: float, least: float, target_level: Column) -> Column:
    """Width of a link by the level of its target."""
    return F.greatest(F.lit(least), F.lit(base) - F.lit(0.3) * target_level)


def font_size(is_root: Column, level: Column) -> Column:
    return F.when(is_root, F.lit(14.0)).otherwise(F.greatest(F.lit(10.0), F.lit(12.0) - F.lit(0.5) * level))


def bold(is_root: Column, level: Column) -> Column:
    return is_root | (level == 1)


@dataclass(frozen=True)
class Forces:
    """Parameters of a map's layout; the layout itself is the drawing program's."""

    root_charge: float
    charge: float
    root_collision: int
    collision: tuple[int, int, int]  # at level 0, less for each level, at least
    ring: tuple[int, int]  # at level 0, more for each level
    distance: tuple[int, int]  # between equal levels, more for each level apart

    def charges(self, is_root: Column, level: Column) -> Column:
        return F.when(is_root, F.lit(self.root_charge)).otherwise(F.lit(self.charge) / (level + 1))

    def collisions(self, is_root: Column, level: Column) -> Column:
        most, step, least = self.collision
        return F.when(is_root, F.lit(self.root_collision)).otherwise(F.greatest(F.lit(least), F.lit(most) - step * level))

    def rings(self, level: Column) -> Column:
        return F.lit(self.ring[0]) + self.ring[1] * level

    def distances(self, source_level: Column, target_level: Column) -> Column:
        return F.lit(self.distance[0]) + self.distance[1] * F.abs(target_level - source_level)


VOUCH_FORCES = Forces(-1500.0, -800.0, 90, (70, 3, 60), (150, 250), (250, 150))
REVIEW_FORCES = INVITATION_FORCES = Forces(-800.0, -400.0, 70, (50, 2, 40), (120, 180), (180, 100))


def arrow(source: tuple[Column, Column], target: tuple[Column, Column], both_ways: Column, radii: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """x, y and angle (degrees) of a link's arrow: its middle, between the nodes' rims if radii are given; nearer to the target if there is a link back."""
    dx, dy = target[0] - source[0], target[1] - source[1]
    turn, length = F.atan2(dy, dx), F.hypot(dx, dy)
    shift = (radii[0] - radii[1]) / 2 if radii else F.lit(0.0)
    ahead = F.when(both_ways & (length > 0), F.lit(float(ARROW_OFFSET)) / length).otherwise(F.lit(0.0))
    return {
        "x": (source[0] + target[0]) / 2 + F.cos(turn) * shift + dx * ahead,
        "y": (source[1] + target[1]) / 2 + F.sin(turn) * shift + dy * ahead,
        "angle": F.degrees(turn),
    }


def radii(source_root: Column, source_level: Column, target_root: Column, target_level: Column) -> tuple[Column, Column]:
    return node_radius(source_root, source_level), node_radius(target_root, target_level)
