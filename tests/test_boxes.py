"""The box tree of the skyline: even boxes, and a cost that grows with the sample, not with the square of the boxes."""

import numpy as np
import pytest

from specval.operators import skyline


@pytest.mark.parametrize("boxes", [1, 7, 256, 3000])
def test_boxes_are_even(boxes):
    sample = np.random.default_rng(1).normal(size=(30_000, 3))
    sizes = np.unique(skyline.Boxes(sample, boxes).place(sample), return_counts=True)[1]
    assert len(sizes) == boxes and sizes.max() <= 2 * len(sample) / boxes + 1


def test_rows_touched_grow_with_the_logarithm_of_the_boxes(monkeypatch):
    touched, original = [0], np.partition

    def counted(values, k):
        touched[0] += len(values)
        return original(values, k)

    monkeypatch.setattr(skyline.np, "partition", counted)
    sample = np.random.default_rng(2).normal(size=(50_000, 4))
    for boxes in (64, 512, 4096):
        touched[0] = 0
        skyline.Boxes(sample, boxes)
        assert touched[0] <= len(sample) * (np.log2(boxes) + 2)


def test_points_that_cannot_be_cut():
    same = np.ones((500, 2))
    assert len(np.unique(skyline.Boxes(same, 8).place(same))) == 1
    mixed = np.concatenate((same, np.random.default_rng(3).normal(size=(20, 2)), [[np.inf, 1.0]]))
    assert 8 <= len(np.unique(skyline.Boxes(mixed, 9).place(mixed))) <= 9
    assert len(skyline.Boxes(np.zeros((0, 2)), 4).place(np.ones((3, 2)))) == 3
