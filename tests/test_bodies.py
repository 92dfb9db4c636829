"""Function bodies around ``await`` and ``yield``, told by hand from the positions of the tokens."""

from lexframe.operators import nodes as N
from lexframe.operators import tokens as K

SCRIPT = """async function f() {
  const g = async x => await y, v = await z;
  const h = async a => async b => [async c => await a(async d => await d), await b]
  await h
  const k = p ? async x => q ? await x : await y : await w;
  `${async x => await x} ${await f} `;
  run(async () => await a, await b);
}
"""
# use and first token of the innermost body around it; 5 is the brace of f
EXPECTED = [(12, 12), (17, 5), (33, 33), (39, 39), (43, 29), (46, 5), (58, 56), (61, 56), (64, 5), (71, 71), (74, 5), (84, 84), (87, 5)]


def test_innermost_bodies(scripts_of):
    rows = N.generators_async(K.tokenize(scripts_of(SCRIPT, "await x; y => ; async z => await", ""))).collect()
    assert sorted((r.pos, r.body_pos) for r in rows if r.script_id == "000") == EXPECTED
    # outside of functions there is none; a body without a token is none; the last one ends with the script
    assert sorted((r.pos, r.body_pos) for r in rows if r.script_id == "001") == [(0, None), (9, 9)]


def test_deep_nesting(scripts_of):
    """Each arrow on one level is the body of the one before."""
    n = 40
    source = " ".join(f"async a{i} => [await a{i}, " for i in range(n)) + "0" + "]" * n + "\nawait b"
    rows = N.generators_async(K.tokenize(scripts_of(source))).collect()
    assert sorted((r.pos, r.body_pos) for r in rows) == [(7 * i + 4, 7 * i + 3) for i in range(n)] + [(8 * n + 1, None)]
