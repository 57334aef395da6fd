"""A labelled collection of images: rows, the transform they are read through, and their class index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lodestar.functions.image import Transform, apply, augment, to_tensor
from lodestar.operators.splits import class_index


def evaluation(img, rng):
    """The transform of a collection that names none."""
    return to_tensor(img)


def training(img, rng):
    """Augmentation, then the evaluation transform."""
    return to_tensor(augment(img, rng))


@dataclass(frozen=True)
class Collection:
    """``rows``: item_id, path, label, image, as ``labelled_images`` gives them."""

    rows: DataFrame
    transform: Transform | None = None

    def tensors(self, seed: int = 42) -> DataFrame:
        """(path, label, tensor); another seed draws other augmentations."""
        return apply(self.rows, [self.transform or evaluation], seed)

    def index(self) -> DataFrame:
        """Each item's place among its class's."""
        return class_index(self.rows.select("label", "item_id"), "label", "item_id")

    def with_transform(self, transform: Transform | None) -> Collection:
        return replace(self, transform=transform)

    def subset(self, keys: DataFrame) -> Collection:
        """The items whose item_id is in ``keys``."""
        return replace(self, rows=self.rows.join(keys.select("item_id"), "item_id", "left_semi"))
