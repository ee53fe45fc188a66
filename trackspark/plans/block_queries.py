"""Voxel queries in block form; their SQL is that of the row form."""

from __future__ import annotations

from trackspark.operators import blocks as B
from trackspark.plans.fixtures import Inputs
from trackspark.plans.registry import REGISTRY, query, r6
from trackspark.plans.volume_queries import SCALES, UM, VOXEL

#: Planes a slab in these queries: half a frame of the fixture, so that planes are exchanged.
DEPTH = 2


def _sql(name: str) -> str:
    return REGISTRY[name].sql


@query("v2_frame_normalise_blocks", "V2 D2", _sql("v2_frame_normalise"))
def frame_normalise(i: Inputs):
    return B.to_voxels(B.normalised(B.to_slabs(i.voxels, DEPTH))).select(*VOXEL, r6("v"))


@query("v3_gaussian_blocks", "V3", _sql("v3_gaussian"))
def gaussian(i: Inputs):
    s = 1.5 / 1.625
    return B.to_voxels(B.gaussian(B.to_slabs(i.voxels, 1), {"smooth": (s, s, s)})).select(*VOXEL, r6("smooth"))


@query("v4_dog_response_blocks", "V4", _sql("v4_dog_response"))
def dog_response(i: Inputs):
    dog = B.dog_response(B.normalised(B.to_slabs(i.voxels, DEPTH)), UM, SCALES)
    return B.to_voxels(dog).select(*VOXEL, r6("dog"))


@query("w6_box_max_blocks", "W6", _sql("w6_box_max"))
def box_max(i: Inputs):
    return B.to_voxels(B.box_max(B.to_slabs(i.voxels, DEPTH), (1, 2, 1))).select(*VOXEL, r6("peak"))


@query("w7_ball_max_blocks", "W7", _sql("w7_ball_max"))
def ball_max(i: Inputs):
    return B.to_voxels(B.ball_max(B.to_slabs(i.voxels, 1), 2.5, UM)).select(*VOXEL, r6("peak"))


@query("v6_dog_peaks_blocks", "V6 P6", _sql("v6_dog_peaks"))
def dog_peaks(i: Inputs):
    return B.detect_dog(B.to_slabs(i.voxels), UM, 3.5, SCALES).select(*VOXEL, r6("score"))


@query("v6_dog_peaks_halo", "V6 P6", _sql("v6_dog_peaks"))
def dog_peaks_halo(i: Inputs):
    return B.detect_dog(B.to_slabs(i.voxels, DEPTH), UM, 3.5, SCALES).select(*VOXEL, r6("score"))


@query("v8_refined_centroids_blocks", "V8", _sql("v8_refined_centroids"))
def refined_centroids(i: Inputs):
    found = B.detect_dog(B.to_slabs(i.voxels, DEPTH), UM, 3.5, SCALES, refine_um=2.5)
    return found.select("dataset", "t", *[r6(f"r{a}").alias(a) for a in "zyx"])
