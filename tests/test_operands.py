"""Operators with their operands as text, written by hand."""

import pytest

from lexframe.operators import nodes as N
from lexframe.operators import tokens as K

CASES = {
    "x = a + b * c - d ** -e ** f, y;": [
        "x [=] a + b * c - d * * - e * * f", "a [+] b * c", "b [*] c", "a + b * c [-] d * * - e * * f", "d [**] - e * * f", "[-] e * * f", "e [**] f",
        "x = a + b * c - d * * - e * * f [,] y"],
    "p = q ? r = 1 : s ? t || u : v + 1, z": [
        "p [=] q ? r = 1 : s ? t || u : v + 1", "q [?] r = 1 : s ? t || u : v + 1", "r [=] 1", "s [?] t || u : v + 1", "t [||] u", "v [+] 1",
        "p = q ? r = 1 : s ? t || u : v + 1 [,] z"],
    "a ? b ? c : d : e = f": ["a [?] b ? c : d : e = f", "b [?] c : d", "e [=] f"],
    # commas: sequences, and those between arguments, elements, properties, parameters, declarators and specifiers
    "if (a, b) c = d; f(a, b + 1)[g, h];": ["a [,] b", "c [=] d", "b [+] 1", "g [,] h"],
    "let i = (j, k), l = [m, n], q = { r, s };": ["i [=] ( j , k )", "j [,] k", "l [=] [ m , n ]", "q [=] { r , s }"],
    "for (i = 0, j = 1; i < n; i++, j--) { o = { p: q & 1, r } }": [
        "i [=] 0", "i = 0 [,] j = 1", "j [=] 1", "i [<] n", "i [++]", "i ++ [,] j --", "j [--]", "o [=] { p : q & 1 , r }", "q [&] 1"],
    "import u, { v, w } from 'x'; function k(a, b) {} class C { m(a, b) {} } (a, b) => a, async(c, d)": ["( a , b ) => a [,] async ( c , d )"],
    "x = class A {}, function () {}, y": ["x [=] class A { }", "x = class A { } [,] function ( ) { }", "x = class A { } , function ( ) { } [,] y"],
    "`${a, b}`": ["a [,] b"],
    # arrows, statements, inserted semicolons
    "w = x => x + 1, !y && z\n--u + 1": ["w [=] x => x + 1", "x [+] 1", "w = x => x + 1 [,] ! y && z", "[!] y", "! y [&&] z", "[--] u", "-- u [+] 1"],
    "g = () => { a - b }, h = function () { c % d }": ["g [=] ( ) => { a - b }", "a [-] b", "g = ( ) => { a - b } [,] h = function ( ) { c % d }", "h [=] function ( ) { c % d }", "c [%] d"],
    "a = b = c + d; if (a) {} else e /= f\nreturn g === typeof v || -w++ > 2": [
        "a [=] b = c + d", "b [=] c + d", "c [+] d", "e [/=] f", "g [===] typeof v", "[typeof] v", "g === typeof v [||] - w ++ > 2", "[-] w ++", "w [++]", "- w ++ [>] 2"],
    "for (const k of e + f) g -= h in k; switch (a) { case b + 1: c ^ d }": ["e [+] f", "g [-=] h in k", "h [in] k", "b [+] 1", "c [^] d"],
    "": [],
    "a + ; (b - ]": ["a [+]", "b [-]"],
}


@pytest.fixture(scope="module")
def found(spark, scripts_of):
    tokens = K.tokenize(scripts_of(*CASES)).cache()
    words = {}
    for t in tokens.collect():
        words.setdefault(t.script_id, {})[t.pos] = t.text
    out = {}
    for r in sorted(N.operators(tokens).collect(), key=lambda r: (r.script_id, r.pos)):
        text = words[r.script_id]
        own = r.pos + (2 if r.operator == "**" else 1)
        left = [text[i] for i in range(r.pos if r.left_start is None else r.left_start, r.pos)]
        right = [text[i] for i in range(own, own if r.right_end is None else r.right_end + 1)]
        out.setdefault(r.script_id, []).append(" ".join([*left, f"[{r.operator}]", *right]))
    return out


@pytest.mark.parametrize("n,source", list(enumerate(CASES)))
def test_operands(found, n, source):
    assert found.get(f"{n:03d}", []) == CASES[source]
