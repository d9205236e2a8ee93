"""Recordings: the filter against its formula, blocks against whole signals, trials against plain NumPy, and the way through prepare."""

import numpy as np
import pytest

from tamarack import benchmark
from tamarack.config import Config
from tamarack.operators import signal
from tamarack.sources import archive, recordings, shards

RATE, SECONDS = 100, 1.0
CHANNELS = ["C3", "Cz", "C4"]


def write_edf(path, x, events, rate=RATE, kind="EDF+C", records=None):
    """x in microvolts; one-second records; annotations lie in the record of their onset."""
    n, width = x.shape[1] // rate, 60
    cell = lambda v, k: str(v)[:k].ljust(k).encode()
    labels = [*CHANNELS, recordings.ANNOTATIONS]
    head = [cell("0", 8), cell("X", 80), cell("Y", 80), cell("01.01.01", 8), cell("00.00.00", 8), cell(256 * (len(labels) + 1), 8), cell(kind, 44), cell(n if records is None else records, 8), cell(1, 8), cell(len(labels), 4)]
    fields = [(labels, 16), ([""] * 4, 80), (["uV", "uV", "uV", ""], 8), ([-400] * 3 + [-1], 8), ([400] * 3 + [1], 8), ([-32768] * 4, 8), ([32767] * 4, 8), ([""] * 4, 80), ([rate] * 3 + [width], 8), ([""] * 4, 32)]
    raw = np.clip(np.round((x + 400) / 800 * 65535 - 32768), -32768, 32767).astype("<i2")
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"".join(head) + b"".join(cell(v, k) for values, k in fields for v in values))
        for k in range(n):
            f.write(raw[:, k * rate : (k + 1) * rate].tobytes())
            said = f"+{k}\x14\x14\x00" + "".join(f"+{o}\x150\x14{t}\x14\x00" for o, t in events if int(o) == k)
            f.write(said.encode().ljust(2 * width, b"\x00"))
    return (raw.astype(float) + 32768) / 65535 * 800e-6 - 400e-6


def plain_sections(x, sos, begin):
    """One sample after another, one section after another."""
    out = x.copy()
    for (b0, b1, b2, _, a1, a2), (s0, s1) in zip(sos, begin, strict=True):
        for k, v in enumerate(out):
            y = b0 * v + s0
            s0, s1, out[k] = b1 * v - a1 * y + s1, b2 * v - a2 * y, y
    return out


def plain_zero_phase(x, sos):
    rest, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:  # a constant's state in each section
        y = level * (b0 + b1 + b2) / (1 + a1 + a2)
        rest.append((y - b0 * level, b2 * level - a2 * y))
        level = y
    rest = np.array(rest)
    edge = 3 * (2 * len(sos) + 1)
    long = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    y = plain_sections(long, sos, rest * long[0])
    return plain_sections(y[::-1].copy(), sos, rest * y[-1])[::-1][edge:-edge]


def plain_resampled(x, up, down):
    most = max(up, down)
    h = np.sinc(np.arange(-10 * most, 10 * most + 1) / most) * np.kaiser(20 * most + 1, 5.0)
    h *= up / h.sum()
    full = np.zeros(len(x) * up)
    full[::up] = x
    return np.convolve(full, h)[10 * most :][: len(x) * up][::down]


@pytest.mark.parametrize("low,high,rate", [(8, 30, 100), (8, 30, 250), (0.5, 40, 512)])
def test_band_pass_is_butterworth(low, high, rate):
    sos = signal.band_pass(low, high, rate)
    f = np.linspace(0.2, rate / 2 - 1, 300)
    z = np.exp(2j * np.pi * f / rate)
    h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos], axis=0)
    w, w1, w2 = np.tan(np.pi * f / rate), *np.tan(np.pi * np.array([low, high]) / rate)
    assert np.allclose(abs(h) ** 2, 1 / (1 + ((w * w - w1 * w2) / (w * (w2 - w1))) ** 8), atol=1e-9)
    assert all(abs(np.roots([1, a1, a2])).max() < 1 for *_, a1, a2 in sos)
    with pytest.raises(ValueError):
        signal.band_pass(8, 60, 100)


def test_zero_phase_and_resampling_are_plain():
    r = np.random.default_rng(0)
    x = r.normal(size=(2, 777)).cumsum(1)
    s = signal.system(8, 30, 100)
    got = signal.zero_phase(x, s)
    for own, z in zip(x, got, strict=True):
        assert np.allclose(z, plain_zero_phase(own, signal.band_pass(8, 30, 100)), atol=1e-10)
    for rate, wanted, up, down in ((250, 128, 64, 125), (100, 128, 32, 25), (128, 128, 1, 1)):
        want = x if up == down else np.array([plain_resampled(v, up, down) for v in x])
        assert np.allclose(signal.resampled(x, rate, wanted), want, atol=1e-10)


def test_blocks_pass_their_state_on():
    r = np.random.default_rng(1)
    x, s = r.normal(size=(3, 1000)), signal.system(8, 30, 100)
    whole, end = s.run(x, np.zeros((3, 8)))
    cuts = [0, 100, 163, 700, 1000]
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    ends = np.array([s.run(p, np.zeros((3, 8)))[1] for p in parts])
    begin = s.begun(np.diff(cuts), ends, np.zeros((3, 8)))
    assert np.allclose(np.concatenate([s.run(p, b)[0] for p, b in zip(parts, begin, strict=True)], 1), whole, atol=1e-12)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two subjects, two sessions of one and two runs; events at the edges, between samples and in the way of blocks."""
    root, made, r = tmp_path_factory.mktemp("raw"), {}, np.random.default_rng(3)
    for subject, session, run, seconds in (("1", "1", "1", 41), ("1", "2", "1", 23), ("2", "1", "1", 37), ("2", "1", "2", 30)):
        x = 20 * r.normal(size=(3, seconds * RATE)).cumsum(1) / 10
        x -= x.mean(1, keepdims=True)
        events = [(round(2.5 * k + float(r.random()), 3), "left_hand" if k % 2 else "right_hand") for k in range(1, seconds // 3)] + [(0.1, "left_hand"), (0.0, "rest"), (seconds - 0.5, "right_hand"), (4.0, "tongue")]
        path = root / "Own" / f"sub-{subject}" / f"ses-{session}" / f"sub-{subject}_ses-{session}_task-imagery_run-{run}_eeg.edf"
        made[(subject, int(session), int(run))] = (write_edf(path, x, events), events)
    return root, made


def plain_trials(made, channels, tmin=-0.5, tmax=1.5, wanted=128):
    out = {}
    sos = signal.band_pass(8, 30, RATE)
    for (subject, session, run), (x, events) in sorted(made.items()):
        z = np.array([plain_zero_phase(x[CHANNELS.index(c)], sos) for c in channels])
        for onset, text in sorted(events):
            a = round(onset * RATE) + round(tmin * RATE)
            b = a + round((tmax - tmin) * RATE) + 1
            if text in archive.EVENTS and a >= 0 and b <= x.shape[1]:
                k = sum(u.startswith(f"Own:{subject}:") for u in out)
                out[f"Own:{subject}:{session}:{run}:{k:05d}"] = (archive.EVENTS[text], np.array([plain_resampled(v, 32, 25) for v in z[:, a:b]]))
    return out


@pytest.mark.parametrize("seconds,channels", [(3.0, None), (60.0, ["C4", "C3"])])
def test_trials_are_the_plain_ones(spark, folder, seconds, channels):
    root, made = folder
    cut = recordings.Cut(8, 30, -0.5, 1.5, 128, archive.EVENTS, channels, seconds)
    got = {r.trial_uid: (r.label, np.array(r.x)) for r in recordings.trials(spark, "Own", str(root / "Own"), cut).collect()}
    want = plain_trials(made, channels or CHANNELS)
    assert got.keys() == want.keys() and len(want) > 30
    for uid, (label, x) in want.items():
        assert got[uid][0] == label and np.allclose(got[uid][1], x, atol=1e-15 + 1e-9 * abs(x).max())
    one = recordings.trials(spark, "Own", str(root / "Own"), cut, ["2"])
    assert {r.subject for r in one.select("subject").collect()} == {"2"}


def test_blocks_as_a_data_source(spark, folder):
    root, made = folder
    recordings.register(spark)
    df = spark.read.format("recordings").option("path", str(root / "Own")).option("seconds", "7").option("channels", "Cz").load()
    assert df.rdd.getNumPartitions() == sum(max(1, x.shape[1] // 700) for x, _ in made.values())
    rows = sorted(df.filter("path like '%sub-2%run-2%'").collect(), key=lambda r: r.block)
    x, events = made[("2", 1, 2)]
    assert np.allclose(np.concatenate([np.array(r.x) for r in rows], 1), x[1:2], atol=1e-12)
    assert [r.start for r in rows] == [700 * k for k in range(len(rows))] and {(e.onset, e.text) for r in rows for e in r.events} == set(events)


def test_what_cannot_be_read_raises(tmp_path):
    x = np.zeros((3, 500))
    for name, more, said in (("a", {"kind": "EDF+D"}, "discontinuous"), ("b", {"records": 9}, "promised")):
        write_edf(tmp_path / f"{name}.edf", x, [], **more)
        f, size = recordings.opened(str(tmp_path / f"{name}.edf"))
        with pytest.raises(ValueError, match=said):
            recordings.header(f, size)
    write_edf(tmp_path / "c.edf", x, [], records=-1)
    f, size = recordings.opened(str(tmp_path / "c.edf"))
    h = recordings.header(f, size)
    assert h.records == 5
    with pytest.raises(ValueError, match="not recorded"):
        h.chosen(["Oz"])
    with pytest.raises(ValueError, match="more than"):
        signal.extended(np.zeros((1, 20)), 27, True, True)


def test_prepare_takes_recordings(spark, folder, tmp_path):
    root, made = folder
    given = {
        "experiment": {"name": "own", "seed": 1, "output_root": str(tmp_path / "r"), "processed_root": str(tmp_path / "p"), "cache_root": str(root)},
        "preprocessing": {"tmin": -0.5, "tmax": 1.5, "channels": ["C3", "C4"]}, "datasets": [{"name": "Own"}],
    }
    c = Config(given)
    benchmark.prepare(spark, c)
    saved = {r.trial_uid: np.array(r.x) for r in shards.load(spark, c.processed_dir, "Own").collect()}
    want = plain_trials(made, ["C3", "C4"])
    assert saved.keys() == want.keys()
    assert all(np.array_equal(x, x.astype(np.float32)) and np.allclose(x, want[u][1], atol=1e-6 * abs(want[u][1]).max()) for u, x in saved.items())
    assert benchmark.validate_data(spark, c).count() == 2
    with pytest.raises(ValueError, match="no recordings"):
        benchmark.prepare(spark, Config(given | {"datasets": [{"name": "Other"}]}))
