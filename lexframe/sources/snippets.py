"""Small scripts, one per construct, that the corpus adapters repeat over the supplied tables.

Placeholders: ``@K`` order key, ``@C`` customer key, ``@S`` order status, ``@P`` whole price,
``@M``/``@E`` key and extension of the exporting module of the same block, ``@G``/``@N``/``@F``
directory, key and extension of the exporting module of the block before.
"""

from __future__ import annotations

VALID = [
    # exporting module: must stay the first
    'import { base as lower } from "../d@G/m@N@F";\nexport const limit@K = @P, unit = 1;\nexport function grow(n, step = 2) {\n  return n + step * lower;\n}\n'
    'export { limit@K as ceiling, unit };\nexport class Gauge {}\nexport default async function probe() {}\nexport const base = @C;\n',
    'import probe, { ceiling as top, unit } from "./m@M@E";\nimport * as kit from "./m@M@E";\nimport "./side@C.js";\n'
    'export * from "./m@M@E";\nexport * as tools from "./m@M@E";\nexport { grow } from "./m@M@E";\nkit.run(probe, top, unit, @K);\n',
    'import def from "lib@C";\nimport { missing } from "./m@M@E";\nconst got = await def(@K, missing);\nexport default got;\n',
    '// counters\nvar total = @P;\nlet left = 0x1F, right = 017;\nconst scale = .5e3 + 1. + 2e-3;\ntotal = left + right * scale;\n',
    'function add(a, b) {\n  return a + b;\n}\nvar r@K = add(@C, @P)\nvar s = r@K / 2 / 1\n',
    'if (x@C > 5) {\n  log("big");\n} else if (x@C) log("small")\nelse {\n  log("none", @K);\n}\n',
    'for (var i = 0, n = @C; i < n; i++) { if (i % 2) continue; sum += i; }\nfor (const k in table) use(k);\nfor (let [p, q = 1] of pairs) { use(p, q); break }\n',
    'outer: while (count < @P) {\n  do {\n    count++;\n  } while (count < 3);\n  break outer;\n}\n',
    'switch (kind) {\n  case "@S":\n    run(@K);\n    break;\n  case 2:\n  default:\n    stop();\n}\n',
    'try {\n  throw { code: @K, info: { tag: "@S" } };\n} catch ({ code, info: { tag = "none" } = {} }) {\n  log(code, tag);\n} finally {\n  done = true;\n}\n',
    'with (scope@C) {\n  value = @P;\n}\nvoid value;\ntypeof value;\ndelete scope@C.value;\n',
    'const { a, b: alias = 2, ...others } = source@K;\nlet [head, , tail = @C, ...more] = [1, 2, 3];\n({ foo: target.name, bar = 2 } = payload);\n',
    'const twice = (x) => x * 2;\nconst wrap = () => ({ value: @K });\nconst run = async (a, [b, c = 1] = [], ...rest) => {\n  return await a(b, c, rest);\n};\nconst one = item => item + @C;\nconst eager = async value => value;\n',
    'const who = "@S";\nconst text = `id ${who} of ${@K + 1}!`;\nconst deep = `a ${`b ${who} c`} d`;\nconst plain = `just text`;\nconst tagged = tag`x${who}y${@C}z`;\n',
    'class Shape@K extends Base {\n  constructor(w, h) {\n    super(w);\n    this.h = h;\n  }\n  area() {\n    return this.w * this.h;\n  }\n  get size() {\n    return @C;\n  }\n  set size(v) {\n    this.w = v;\n  }\n'
    '  static make() {\n    return new Shape@K(1, 2);\n  }\n  static get kind() {\n    return "@S";\n  }\n  ["calc" + "@S"](n) {\n    return n;\n  }\n}\n',
    'const Box = class {\n  *items() {\n    yield this.first;\n    yield* this.rest;\n  }\n  async load(u) {\n    return await fetch(u, @K);\n  }\n  async *pages() {\n    for await (const p of this.load("@S")) {\n      yield p;\n    }\n  }\n};\n',
    'const api = {\n  base,\n  [key + "@S"]: @K,\n  method(v = 1) {\n    return v;\n  },\n  *gen() {\n    yield 1;\n  },\n  get first() {\n    return this.base;\n  },\n  set first(t) {\n    this.base = t;\n  },\n  async go() {},\n  ...mixin,\n  "quoted key": null,\n  42: undefined,\n};\n',
    'function* counter(start = 0) {\n  let v = start;\n  while (v < @C) {\n    yield v;\n    v += 1;\n  }\n  return yield* other(v);\n}\nasync function* feed(src) {\n  for await (const x of src) yield x;\n}\n',
    'var re = /[/\\]]+@K/gi, q = a / b / c;\nif (/^x$/.test(name)) hit(re);\nfunction f() {\n  return /* why */ /end/;\n}\nvar y = (a + b) / 2;\n',
    'flags = a >>> 1 >> 2 << 3;\nflags >>>= 1;\nflags <<= 2;\nflags >>= 3;\nflags &= 7;\nflags |= @K & ~mask ^ 3;\nok = a && b || !c;\nok = a === b !== (c == d) != e;\nlow = a <= b, high = a >= @C;\n',
    'var pick = flag ? { value: @K } : { value: 2 };\nvar inner = a ? b ? 1 : 2 : c ? 3 : 4;\nvar fn = flag ? (x) => x : function (y) { return y; };\n',
    'var a@K = 1\nvar b = a@K\n++b\nvar c = "@S"\n  , d = 2\nc = b\n  && d\nfoo()\n(function () { return 1 })()\n',
    'function late() {\n  return\n  @K\n}\nfunction stop() { throw err }\ndo { n-- } while (n)\nlate()\n',
    'obj.if.else = obj.return(@K);\nobj.get = { if: 1, class: 2, default: 3 };\nobj["key"].list[0].call(this, ...args, @C);\nnew Foo;\nnew Bar(1).baz().qux = new lib.Deep(@K, 2);\n',
    'define(["dep@C"], function (dep) {\n  var self = this, n = dep.load("@S", function done(err) {\n    if (err) throw err;\n  });\n  return { start: n, stop() {} };\n});\n',
    'let s = "it\'s \\"@S\\"", t = \'two\\nlines\';\nlet multi = "first \\\nsecond";\nlet u = \\u0061bc$_1, z = s + t + multi;\n/* block\n * comment **/ let done = true;\n',
    'label@K: for (;;) {\n  for (x of list) {\n    if (x === null) continue label@K;\n    if (x === undefined) break label@K;\n  }\n}\n',
    'let x1 = a, y1 = b * c % d - e + @K;\nx1 += 1; x1 -= 2; x1 *= 3; x1 /= 4; x1 %= 5; x1 ^= 6;\ny1++; --y1; -x1; +y1; !ok;\nkey in table; item instanceof Type;\n(x1, y1, @C);\n',
    '(function (root, factory) {\n  "use strict";\n  root.lib@C = factory(root);\n}(this, function (w) {\n  return w["@S"] || {};\n}));\n!function () { go(@K) }();\n',
    'const later = new Promise((ok, fail) => setTimeout(() => ok(@K), @C));\nlater.then((v) => v * 2).catch((e) => { log(e); });\nconst list = [1, , 3, ...later, [4, [5]]];\n',
    'debugger;\nvar o = { a: { b: { c: [{ d: @K }] } } };\nvar { a: { b: { c: [{ d }] } } } = o;\nif (o) { { ; } }\n',
    'const nested = `x ${ list.map((v) => `<i>${ v }</i>`).join("") } y ${ { k: @K }.k } z`;\nlet price = `$${@P} \\${no} `;\nlet path = `a/b`.split("/");\n',
    'var empty = {}, none = [], fnc = function () {}, arrow = () => {};\nfunction named() {}\nclass Bare {}\nif (empty) ; else none;\nwhile (false);\n',
    'async function main() {\n  await step(@K);\n  const all = await Promise.all([one(), two()]);\n  return all;\n}\nmain();\n',
    '\n\n   \t// only a comment @K\n/* and a block */\n',
    'class Words@K {\n  get default() {\n    return @C;\n  }\n  set delete(v) {\n    this.v = v ** 2;\n  }\n  static new() {\n    return 1;\n  }\n  async import(u) {\n    return u;\n  }\n'
    '  *in() {\n    yield 1;\n  }\n}\nconst words = { a, if() {\n  return "@S";\n}, async for(x) {} };\n',
    'function open@K({ a, b: { c = @C, ...d } = {} }, [e, , g = 2] = [], ...rest) {}\nconst pick = ({ r, [key]: v }, [s, { t: [u] }]) => r + s;\n'
    '({ p: obj.x, q: [m[0], this.n], "z z": w } = load("@S"));\nfor ({ k } of list) use(k);\nclass Opt { set size({ w = [1] }) {} m([i, ...j]) {} }\n',
    'a = b\n/re@C/g.exec(c);\nvar t = typeof /x/;\nvar m = [/a/, /b/i];\nvar g = { r: /c/ };\n',
]

#: ``path`` of these holds ``test_error``.
INVALID = [
    'var obj = {\n  name "@S",\n  value: @K\n};\n',
    'for (var i = 0; i < @C; i++ {\n  go(i);\n}\n',
    'const bad = (v)\n=> v + @K;\nfunction* g() {\n  yield\n  @C;\n}\n',
    'class A@K {\n  get size(x) { return x; }\n  set size() {}\n  static constructor() {}\n  odd thing() {}\n}\nfunction f(...rest, last) {}\n',
    'if (ok@K) {\n  call((1 + 2];\n',
    'const t = `value ${}`;\nvar n = @K é;\nlet open = `never closed @C;\n',
    'while () go(@K);\nfor (let i = 0; i < @C) go(i);\ntry { go() }\nlast(1,,2);\n',
    'function () { return @K }\nswitch (a) { b }\nconst pick = a ? b;\ndo go(@C);\n',
    'import { a of b } form "x@K";\nfor (const v = 0 of list) v;\nexport * az ns from "y";\n',
]

ALL = VALID + INVALID
COUNT = len(ALL)
PLACEHOLDERS = ["K", "C", "S", "P", "M", "E", "G", "N", "F"]
