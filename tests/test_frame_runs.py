"""Tasks of the frame source follow the frames that exist."""

from trackspark.sources.frames import TASK_BYTES, FrameReader, FrameRun


def _runs(folder, shape, **limits):
    reader = FrameReader(str(folder), shape, "uint16")
    reader.__dict__.update(limits)
    return reader.partitions()


def test_gaps_make_no_tasks(tmp_path):
    for t in range(0, 4000, 40):
        (tmp_path / "a" / "0" / "c" / str(t)).mkdir(parents=True)
    assert [(r.first, r.last) for r in _runs(tmp_path, (2, 2, 2))] == [(0, 3960)]
    assert [(r.first, r.last) for r in _runs(tmp_path, (2, 2, 2), low=100, high=200)] == [(120, 200)]
    big = _runs(tmp_path, (1, 1, TASK_BYTES // 2 // 40))
    assert [(r.first, r.last) for r in big] == [(0, 1560), (1600, 3160), (3200, 3960)]
    assert all(isinstance(r, FrameRun) for r in big)
