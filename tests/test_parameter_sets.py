"""Parameter sets and slice headers: what is written is read back, and broken bits end in an error."""

import json

import pytest

from framelake.errors import MediaError
from framelake.sources import nal
from framelake.sources import parameter_sets as S

SEQUENCE = {
    "profile": {"profile": 1, "level": 93}, "id": 1, "chroma": 1, "width": 320, "height": 184, "cropped": 1, "crop_bottom": 2, "poc_bits": 4, "ordering_for_each": 1,
    "ordering": [{"buffering": 4, "reorder": 2}], "block_steps": 3, "transform_steps": 3, "scaling": 1, "scaling_given": 1, "offsets": 1, "temporal_motion": 1,
    "lists": {"size0": [{"given": 1, "deltas": [1] * 16}], "size2": [{"given": 1, "dc": 4, "deltas": [0] * 64}, {"back": 1}]},
    "set_count": 2, "sets": [{"before": 2, "after": 1, "earlier": [{"used": 1}, {"step": 1}], "later": [{"step": 3, "used": 1}]}, {"predicted": 1, "negative": 1, "marks": [{"used": 1}, {"kept": 1}, {"used": 1}, {"used": 1}]}],
    "long_term": 1, "long_count": 1, "long_lsb": [3], "long_used": [1], "usable": 1,
    "usability": {"timing": 1, "tick": 1001, "time_scale": 30000, "buffer": 1, "timing_buffer": {"nal": 1, "layers": [{"fixed_general": 1, "duration": 3, "nal": [{"rate": 5, "size": 7}]}]}},
}
PICTURE = {"id": 2, "sequence_set": 1, "lists_change": 1, "weighted": 1, "tiles": 1, "columns": 1, "rows": 1, "uniform": 1, "filter_slices": 1, "cabac_init": 1}
HEADER = {
    "picture_set": 2, "address": 7, "type": 1, "poc_lsb": 77, "from_sequence": 1, "temporal_motion": 1, "own_counts": 1, "refs0": 1, "changed0": 1, "entry0": [1, 0], "cabac_init": 1, "collocated": 1,
    "weights": {"luma_log2": 6, "list0": [{"luma": 1, "weight": 3, "offset": -2}, {"chroma": 1, "cb_weight": 1}]}, "merge_less": 1, "qp": -5, "filter_edges": 1, "entry_count": 2, "entry_bits": 7, "entries": [9, 200],
}
VIDEO = {"id": 3, "profile": {"profile": 1}, "sub_layers": 1, "ordering": [{}], "more_layer_sets": 1, "layer_id_most": 2, "layer_sets": [{"included": [1, 0, 1]}], "timing": 1, "tick": 1, "time_scale": 25, "buffer_count": 1, "buffers": [{"vcl": 1, "layers": [{"vcl": [{"rate": 1}]}]}]}


def kept(values, found):
    """Whether all that was given is found again."""
    if isinstance(values, dict):
        return all(kept(v, found[k]) for k, v in values.items())
    if isinstance(values, list):
        return len(values) <= len(found) and all(kept(a, b) for a, b in zip(values, found, strict=False))
    return values == found


def test_sets_and_headers_read_back():
    sps, pps = S.read(S.sequence_set, S.write(S.sequence_set, SEQUENCE)), S.read(S.picture_set, S.write(S.picture_set, PICTURE))
    sets = ({2: pps}, {1: sps})
    for describe, values, more in ((S.video_set, VIDEO, ()), (S.sequence_set, SEQUENCE, ()), (S.picture_set, PICTURE, ()), (S.slice_header, HEADER, (1, *sets))):
        data = S.write(describe, values, *more)
        found = S.read(describe, data, *more)
        assert kept(values, found) and S.write(describe, found, *more) == data
        for n in range(len(data) - 1):
            with pytest.raises(MediaError):
                S.read(describe, data[:n], *more) if describe is not S.picture_set else S.read(describe, b"", *more)
                raise MediaError("MalformedMedia", "read as if it were whole")
    assert S.sequence_facts(sps) == {"width": 320, "height": 180, "chroma": 1, "luma_bits": 8, "chroma_bits": 8, "buffering": 4, "reorder": 2, "poc_lsb": 256}
    with pytest.raises(MediaError):
        S.read(S.slice_header, S.write(S.slice_header, HEADER, 1, *sets), 1, {}, {})


def test_reference_sets():
    sets = S.read(S.sequence_set, S.write(S.sequence_set, SEQUENCE))["sets"]
    assert sets[0]["pictures"] == [(-1, 1), (-3, 0), (4, 1)]
    # one earlier: -2, -4 (kept, not used), 3, and the first set's own picture at -1
    assert sets[1]["pictures"] == [(-1, 1), (-2, 1), (-4, 0), (3, 1)]


def test_scaling_factors():
    lists = S.read(S.sequence_set, S.write(S.sequence_set, SEQUENCE))["lists"]
    assert sorted(S.scaling_factors(lists, 0, 0)) == list(range(9, 25))
    # up along each diagonal: 9 at (0, 0), 10 below, 11 beside it
    assert S.scaling_factors(lists, 0, 0)[:5] == [9, 11, 14, 18, 10]
    assert S.scaling_factors(lists, 2, 0) == [12] + [12] * 255 and S.scaling_factors(lists, 2, 1) == S.scaling_factors(lists, 2, 0)
    assert S.scaling_factors(None, 3, 0) == [16] * 1024 and len(S.DEFAULT_INTRA) == len(S.DEFAULT_INTER) == 64
    plain = {f"size{n}": [{"given": 0, "back": 0}] * 6 for n in range(4)}
    assert S.scaling_factors(plain, 1, 0)[0] == 16 and S.scaling_factors(plain, 1, 0)[63] == 115 and S.scaling_factors(plain, 1, 3)[63] == 91 and S.scaling_factors(plain, 3, 1)[-1] == 91


def test_check_sequence():
    sps = S.read(S.sequence_set, S.write(S.sequence_set, SEQUENCE))
    S.check_sequence(sps, 320, 180, 1 << 29)
    for changed, size, most, kind in (({}, (320, 184), 1 << 29, "MalformedMedia"), ({}, (320, 180), 1 << 20, "ResourceLimit"), ({"luma_depth": 2}, (320, 180), 1 << 29, "Unsupported")):
        with pytest.raises(MediaError) as e:
            S.check_sequence(sps | changed, *size, most)
        assert e.value.kind == kind


def test_rows_of_a_stream(spark):
    sps, pps = S.write(S.sequence_set, SEQUENCE), S.write(S.picture_set, PICTURE)
    sets = ({2: S.read(S.picture_set, pps)}, {1: S.read(S.sequence_set, sps)})
    slices = [S.write(S.slice_header, HEADER | {"poc_lsb": n}, 1, *sets) for n in (5, 9)]
    units = [(S.SPS, sps), (S.PPS, pps), (1, slices[0]), (S.PPS, pps[:0]), (1, slices[1]), (35, b"x")]
    df = spark.createDataFrame([(1, i, k, bytearray(d)) for i, (k, d) in enumerate(units)] + [(2, 0, 1, bytearray(slices[0]))], "stream_id long, unit_no long, nal_type int, rbsp binary")
    found = {(r["stream_id"], r["unit_no"]): r for r in S.slice_rows(df).collect()}
    assert {k: (r["poc_lsb"], r["type"], r["qp"], r["address"], r["error_kind"]) for k, r in found.items()} == {(1, 2): (5, "P", -5, 7, None), (1, 4): (9, "P", -5, 7, None), (2, 0): (None, None, None, None, "MalformedMedia")}
    rows = {r["unit_no"]: r for r in S.set_rows(df).collect()}
    assert (rows[0]["width"], rows[0]["height"], rows[0]["reorder"], rows[0]["id"]) == (320, 180, 2, 1) and rows[1]["id"] == 2 and rows[3]["error_kind"] == "MalformedMedia"
    assert json.loads(rows[0]["fields"])["sets"][1]["pictures"][0] == [-1, 1]
    assert nal.split_annexb(nal.join_annexb([bytes([66, 1]) + sps])) == [bytes([66, 1]) + sps]
