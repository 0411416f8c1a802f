"""Scene detectors and speech ranges against loops that go frame by frame."""

import random

import pytest

from cuemill.operators import frames as R, timeline as L


def clips(seed, n=6, frames=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        luma = 80.0
        for f in range(frames):
            luma = max(0.0, min(200.0, luma + rng.uniform(-25, 25)))
            change = None if f == 0 else float(rng.choice([0, 1, 2, 3, 20, 40]) if rng.random() < 0.5 else rng.uniform(0, 5))
            rows.append((k, f + k, luma, change))
    return rows


def cut_up(frames, cuts):
    inner = sorted({c for c in cuts if frames[0] < c <= frames[-1]})
    edges = [frames[0], *inner, frames[-1] + 1]
    return [(i, a, b - 1, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def flashes(frames, above, least):
    """Every frame in turn, with a filter that merges."""
    out, last, first_cut, merging, begun = [], frames[0], False, False, 0
    for f in frames:
        met = f - last >= least
        if f in above:
            last = f
        if merging:
            if met and f not in above and last - begun >= least:
                merging = False
                out.append(last)
        elif f in above and met:
            first_cut = True
            out.append(f)
        elif f in above and first_cut:
            merging, begun = True, f
    return out


def fades(frames, luma, threshold, least):
    out, last, state, since = [], frames[0], None, frames[0]
    for f, x in zip(frames, luma, strict=True):
        now = "out" if x < threshold else "in"
        if state == "in" and now == "out":
            since = f
        if state == "out" and now == "in" and f - last >= least:
            out.append((f + since) // 2)
            last = f
        state = now
    return out + [since] * (state == "out" and frames[-1] - last >= least)


@pytest.mark.parametrize("least", [1, 4, 15])
def test_three_detectors(spark, least):
    rows = clips(least)
    df = spark.createDataFrame(rows, "clip int, frame int, luma double, change double").repartition(3)
    content = R.detect_scenes(df, "clip", "frame", "content", 20.0, least).collect()
    adaptive = R.detect_scenes(df, "clip", "frame", "adaptive", 3.0, least).collect()
    threshold = R.detect_scenes(df, "clip", "frame", "threshold", 60.0, least).collect()
    both = R.detect_scenes(df, "clip", "frame", "content", 20.0, least, fades=60.0).collect()
    for k in range(6):
        own = [r for r in rows if r[0] == k]
        frames, luma, change = [r[1] for r in own], [r[2] for r in own], [r[3] or 0.0 for r in own]
        got = lambda found: sorted((r["scene"], r["first"], r["last"], r["frames"]) for r in found if r["clip"] == k)  # noqa: B023, E731
        cuts = flashes(frames, {f for f, c in zip(frames, change, strict=True) if c >= 20}, least)
        assert got(content) == cut_up(frames, cuts)
        ratio, last, some = {}, frames[0], []
        for i in range(2, len(frames) - 2):
            mean = sum(change[i + d] for d in (-2, -1, 1, 2)) / 4
            ratio[i] = min(change[i] / mean, 255.0) if mean >= 1e-5 else 255.0 * (change[i] > 0)
            if ratio[i] >= 3.0 and change[i] >= 15 and frames[i] - last >= least:
                some.append(frames[i])
                last = frames[i]
        assert got(adaptive) == cut_up(frames, some)
        dark = fades(frames, luma, 60.0, least)
        assert got(threshold) == cut_up(frames, dark)
        assert got(both) == cut_up(frames, cuts + dark)
    with pytest.raises(ValueError):
        R.detect_scenes(df, "clip", "frame", "other")


def loop(p, step, on, off, least_speech, least_silence, pad, longest, edge):
    """A recording from its first frame to its last, with the silence to cut at as positions."""
    out, begun, temp, prev, after = [], None, 0, 0, 0
    limit = longest - step - 2 * pad
    for i, x in enumerate(p):
        t = i * step
        if x >= on and temp:
            temp = 0
            if after < prev:
                after = t
        if x >= on and begun is None:
            begun = t
            continue
        if begun is not None and t - begun > limit:
            if not prev:
                out.append((begun, t))
                begun, temp, after = None, 0, 0
                continue
            out.append((begun, prev))
            begun = None if after < prev else after
            prev = after = temp = 0
        if x < off and begun is not None:
            temp = temp or t
            if t - temp > edge:
                prev = temp
            if t - temp >= least_silence:
                if temp - begun > least_speech:
                    out.append((begun, temp))
                begun, temp, prev, after = None, 0, 0, 0
    end = len(p) * step
    if begun is not None and end - begun > least_speech:
        out.append((begun, end))
    padded = [list(r) for r in out]
    for i in range(len(padded)):
        if i == 0:
            padded[0][0] = max(0.0, padded[0][0] - pad)
        if i + 1 < len(padded):
            gap = padded[i + 1][0] - padded[i][1]
            padded[i][1] += gap / 2 if gap < 2 * pad else pad
            padded[i + 1][0] -= gap / 2 if gap < 2 * pad else pad
        else:
            padded[i][1] = min(end, padded[i][1] + pad)
    return [(round(a, 6), round(b, 6)) for a, b in padded]


@pytest.mark.parametrize("large", [None, 40])
@pytest.mark.parametrize("longest", [float("inf"), 3.0, 1.0])
def test_speech_equals_the_loop(spark, large, longest):
    rng = random.Random(7)
    recordings = {"silent": [0.0] * 50, "loud": [0.9] * 300, "one": [0.9], "between": [0.4] * 60}
    for k in range(5):
        p, level = [], 0.0
        for _ in range(400):
            level = rng.choice([0.0, 0.1, 0.4, 0.6, 0.9]) if rng.random() < 0.2 else level
            p.append(level)
        recordings[f"r{k}"] = p
    rows = [(k, i, x) for k, p in recordings.items() for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "k string, frame int, p double").repartition(3)
    step = 1 / 32
    got = L.speech_ranges(df, "k", step, 0.5, 0.35, 0.25, 0.125, 0.0625, longest, 3 / 32, large).collect()
    for k, p in recordings.items():
        assert sorted((round(r["start_s"], 6), round(r["end_s"], 6)) for r in got if r["k"] == k) == loop(p, step, 0.5, 0.35, 0.25, 0.125, 0.0625, longest, 3 / 32), k
