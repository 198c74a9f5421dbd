"""Valid forms of C17/C23, C++20 and Python 3.13, and invalid ones, a snippet each."""

VALID = {
    "c": [
        "int S;", "int f(int Q){ return Q+1; }", "int I, M, F; char S[3];", "int f(void){ return _Generic(1, int: 2, default: 3); }", '__asm__ volatile("nop" : : : "memory");',
        'void f(void){ __asm__ __volatile__("mov %0, %1" : "=r"(a) : "r"(b) : "cc", "memory"); }', 'void f(void){ asm("nop" :: "r"(x)); }', 'void f(void){ asm goto("jmp %l0" : : : : out); out: return; }',
        "[[nodiscard]] int f(void);", '[[deprecated("old")]] static int g(int x);', "struct [[gnu::packed]] s { int a; };", "void f(void){ switch (a) { case 1: g(); [[fallthrough]]; default: h(); } }",
        "void f(void){ if (a) goto out; b(); out: }", "void f(void){ switch (x) { case 1: int y = 2; break; } }", "constexpr int n = 3;", "auto x = 5;", "static_assert(sizeof(int) == 4);", "_Static_assert(1, \"x\");",
        "enum { false = 0, true = 1 };", "typedef unsigned char bool;", "thread_local int t;", "alignas(16) char buf[64];", "_Alignas(8) int z;", "int n = alignof(int) + _Alignof(long);", "bool b = true; void *p = nullptr;", "_Bool q = false;", "unsigned _BitInt(7) w;",
        "typeof(int *) p; typeof_unqual(x) y;", "enum e : unsigned { A, B = 2, };", "enum e { A [[deprecated]], B };", "int a[] = { [0 ... 3] = 1, [5] = 2 };", "struct s v = { .a.b = 1, .c[2] = 3, };",
        "int x = 1'000'000; int y = 0xFF'FFu;", "char c = '\\'', d = '\\\\', e = L'x';", 'char *s = u8"x" "y" L"z";', "void f(int n, int a[static n], int b[const], int c[*]);", "int (*fp[3])(int, char *);",
        "int (*(*g(int))(void))[4];", "typedef int (*cb)(void *, ...);", "int f(a, b) int a; char *b; { return a; }", "static inline __attribute__((always_inline)) int f(void) { return 0; }", "struct { int a; union { int b; float c; }; } v;",
        "struct s { unsigned a:3, :2, b:4; };", "struct s { int n; char data[]; };", "void f(void){ for (int i = 0, j = 1; i < 3; i++, j--) ; }", "void f(void){ do ; while (0); }", "int x = (int){3}; struct p q = (struct p){ .x = 1 };",
        "int y = ({ int t = 1; t + 2; });", "void f(void){ goto *tab[i]; }", "void *p = &&lab;", "int z = a ?: b;", "int m = sizeof(struct s) / sizeof *p;", "int f(int x) { return x << 2 >> 1 & ~3 | 4 ^ 5; }",
        "void f(void) { list_for_each_entry_safe(a, b, &c, d) { e(a); } }", "DEFINE_MUTEX(lock);", "EXPORT_SYMBOL_GPL(f);", 'MODULE_AUTHOR("a b");', "static DEFINE_PER_CPU(int, x);", "static const struct ops o = { .f = g, .h = &i };",
        "int f(void) { return sizeof(int[3]); }", "extern int printf(const char *fmt, ...) __attribute__((format(printf, 1, 2)));", 'pr_info("%" PRIu64 "\\n", x);', 'int f(void) { return g("%"PRIx32"\\n", 3); }', "#if (1 << 3) > 7\nint a;\n#else\nint b(\n#endif",
        "#define A 2\n#define B A\n#if B == 2\nint a;\n#else\nint b(\n#endif", "#ifdef X\n(\n#elif 1\nint y;\n#else\n(\n#endif", "#if defined(X) && (X > 2 || !defined Y)\n(\n#endif", "#if 0x10u == 16 && 'a' && (3 ? 1 : 0)\nint k;\n#else\n(\n#endif",
        "int f(void)\n{\n\treturn (u32)(a) + (b)(c);\n}", "volatile unsigned long long int v;", "long double ld; _Complex double z;", "const char *const names[] = { \"a\", \"b\" };", "void f(register int a, const volatile void *restrict p);",
        "int f(void){ while (x) { if (a) continue; else break; } return 0; }", "static void (*const h[])(void) = { a, b, };", "int a = b, *c = &a, d[2] = {1, 2};", "union u { int i; float f; } x = { .f = 1.0e-3f };", "int x = 0b1010 + 0777 + 0x1p-3;", ";", "int f(void) { ; ; { } }",
    ],
    "c++": [
        "int S; int Q; template<class S> struct B { S s; };", "int x = 1'000'000;", "template <typename T> requires std::integral<T> T f(T a) { return a; }", "template <typename T> T f(T a) requires std::integral<T> && (sizeof(T) > 2) { return a; }",
        "template <typename T> concept C = requires(T a, T b) { a + b; { a.f() } -> std::same_as<int>; typename T::type; requires sizeof(T) > 1; };", "void f() try { g(); } catch (int e) { }", "A::A() try : b(1) { } catch (...) { }", "struct A { A() try : b(1) { } catch (...) { } };",
        "int *p = new int[3]{1, 2};", "decltype(auto) f() { return (x); }", "template <class... Ts> struct O : Ts... { using Ts::operator()...; };", "template <class... Ts> O(Ts...) -> O<Ts...>;", "auto s = \"abc\"sv; auto n = 10_km;", "auto l = []<typename T>(T x) { return x; };",
        "auto l = [x = 1, &y, this]() mutable noexcept -> int { return x; };", "auto [a, b] = f(); const auto &[c, d] = g();", "for_();", "void f() { for (const auto &[k, v] : m) { } for (auto x : {1, 2}) ; }", "void f() { if (auto it = m.find(k); it != m.end()) { } }",
        "void f() { if constexpr (sizeof(T) == 1) { } else { } }", "void f() { switch (int x = g(); x) { case 1: break; } }", "template <typename... A> auto sum(A... a) { return (a + ...); }", "template <typename... A> auto sum(A &&...a) { return (0 + ... + f(std::forward<A>(a))); }",
        "enum class E : unsigned char { A, B };", "enum class E { A = 1, };", "namespace a::b::c { int x; }", "inline namespace v1 { }", "namespace { int x; }", "using X = std::vector<std::pair<int, int>>;", "template <typename T> using V = std::vector<T>;",
        "class A final : public B, private virtual C { };", "struct A { virtual void f() const noexcept override = 0; };", "struct A { A() = default; A(const A &) = delete; A &operator=(A &&) noexcept = default; ~A(); };", "struct A { explicit operator bool() const { return true; } };",
        "struct A { int x = 3; int y{4}; static inline int z = 5; };", "struct A { bool operator==(const A &) const = default; auto operator<=>(const A &) const = default; };", "A::operator int() const { return 1; }", "std::ostream &operator<<(std::ostream &o, const A &a) { return o << a.x; }",
        "template <> struct A<int> { };", "template <typename T, int N = 3> class A;", "template <template <typename> class C> struct D { };", "extern \"C\" { int f(void); }", "extern \"C\" int g(int);", "static_assert(sizeof(int) == 4, \"x\");", "constexpr int f(int n) { return n < 2 ? 1 : n * f(n - 1); }",
        "auto f() -> std::vector<int>;", "[[nodiscard]] int f();", "void f([[maybe_unused]] int x);", "int main() { std::cout << \"a\" << std::endl; return 0; }", "void f() { delete[] p; delete q; }", "void f() { throw std::runtime_error(\"x\"); }", "void f() { int x{3}; std::string s(\"a\"); std::vector<int> v{1, 2}; }",
        "void f() { auto p = std::make_unique<A>(1, 2); p->g(); (*p).h(); }", "int x = static_cast<int>(y) + reinterpret_cast<long>(z);", "void f() { a.template g<int>(); }", "typename T::value_type f(typename T::x y);", "struct A { template <typename T> void f(T t) { } };", "void f() & ; ", "struct A { void f() &&; void g() const &; };",
        "auto r = R\"(a \" b)\";", "void f() { co_await g(); co_return 1; }", "int f(int = 3, char *s = nullptr);", "void (A::*pm)(int) = &A::f;", "int A::*pd = &A::x;", "void f() { (obj.*pm)(1); (ptr->*pm)(2); }", "template class std::vector<int>;", "extern template class V<int>;", "struct A { friend class B; friend void f(A &); };",
        "thread_local int t; alignas(8) int q;", "void f() { for (;;) { if (x) break; } }", "void f() { try { g(); } catch (const std::exception &e) { } catch (...) { throw; } }", "bool b = a < c && d > e;", "auto x = a < b;", "struct { int a; } s;", "union U { int a; float b; };", "void f() { using namespace std; using std::swap; }", "A a = { .x = 1, .y = 2 };",
        "void f() { std::sort(v.begin(), v.end(), [](const auto &a, const auto &b) { return a.x > b.x; }); }", "int x = sizeof...(Ts);", "template <auto N> struct C { };", "unsigned long long f(void) noexcept(true);", "void f() { return; }", "std::map<std::string, std::vector<int>> m = { {\"a\", {1, 2}}, {\"b\", {}} };",
    ],
    "python": [
        "S = 1\nB = S\n", "with (open(a) as f, open(b) as g):\n    pass\n", "with (a, b):\n    pass\n", "with (yield_):\n    pass\n", "match x:\n    case [a, b, *_] if a > b:\n        pass\n    case (1 | 2) as n:\n        pass\n    case {'k': v, **rest}:\n        pass\n    case Point(x=0, y=0):\n        pass\n    case -1 | 2.5 | 1 + 2j:\n        pass\n    case a.b.c:\n        pass\n    case _:\n        pass\n",
        "match ...:\n    case _:\n        pass\n", "match = 1\nmatch.x = 2\nprint(match)\n", "def f[T: int, *Ts, **P](a: T) -> T:\n    return a\n", "class A[T = int](B[T]):\n    pass\n", "type X[T] = list[T]\n", "type = 3\n", "def f(a, /, b, *, c=1, **k):\n    pass\n", "def f(a, b=1, /, c=2, *args, d, e=3, **kw):\n    pass\n",
        "lambda: 0\n", "lambda a, /, b=1, *c, d, **e: (a, b)\n", "f(*a, b, *c, d=1, *e, **g, h=2)\n", "f(x for x in y)\n", "f(a, (x for x in y))\n", "x = [i async for i in y if await i]\n", "x[a:b, ::2, *c]\n", "x[...] = y[None]\n", "a = b = c, *d = e\n", "(a, b), [c, *d] = x\n", "for a, (b, *c) in d:\n    pass\nelse:\n    pass\n", "del a, b[0], (c.d, e)\n",
        "a: int\nb: str = 'x'\nc.d: int = 1\n(e): int = 2\n", "x += yield\n", "async def f():\n    async with a as b, c:\n        pass\n    async for x in y:\n        pass\n    return await z\n", "try:\n    pass\nexcept* (A, B) as e:\n    pass\nfinally:\n    pass\n", "try:\n    pass\nexcept A:\n    pass\nexcept:\n    pass\nelse:\n    pass\nfinally:\n    pass\n", "try:\n    pass\nfinally:\n    pass\n",
        "if (n := len(a)) > 3: print(n)\n", "while True:\n    break\nelse:\n    pass\n", "@a.b[c](d)\n@e\ndef f(): pass\n", "@x\nclass A: y = 1; z = 2\n", "f'{x!r:>{w}} {y=} {{z}} {a[\"b\"]}'\n", 'f"{x["a"]} {f"{y}"}"\n', "f'''{\n  a\n}'''\n", "rb'\\x' b\"a\" B'c'\n", "x = 0xFF + 0o17 + 0b11 + 1_000 + 1.5e-3j + .5 + 5. + 00\n", "from . import a\nfrom .. import b as c\nfrom ...d.e import (f, g as h,)\nfrom x import *\n", "import a.b.c as d, e\n",
        "global_ = 1\ndef f():\n    global a, b\n    nonlocal_ = 2\n", "assert x, 'y'\n", "raise A from b\nraise\n", "x = a if b else c if d else e\n", "not a in b\na not in b\na is not b\n", "a < b <= c != d\n", "x = {**a, 'b': 1, **c}\ny = {*a, 1}\nz = {}\n", "{a: b for a, b in c if d}\n{a for a in b}\n", "print(*a, sep='')\n", "x = (\n    1,\n    2,\n)\n", "x = 1 + \\\n    2\n", "if a:\n\tb\nelif c:\n\td\n", "def f():\n    '''doc\n    more'''\n", "class A(B, metaclass=C, **k):\n    x: int\n\n    def f(self): ...\n", "a @ b\na @= c\na //= 2\na **= b\na >>= 1\n", "x = yield_ = 3\n", "def g():\n    x = yield a, b\n    yield from c\n    y = (yield)\n", "return_ = [*a, *b]\n", "a[b](c).d\n", "x = ~-+a ** -b\n", "async def f():\n    return [x async for x in y]\n", "é = 'ü'\n", "x = 1if a else 2\n", "with a as (b, c), d as e.f:\n    pass\n", "print('a' 'b'\n      'c')\n", "def f(*, a): pass\n", "def f(*args: *Ts): pass\n", "try:\n    x\nexcept (A, B):\n    y\n", "for x in *a, b:\n    pass\n", "return_: list[int] = []\n", "x = lambda: (yield)\n",
    ],
}

INVALID = {
    "c": [
        "int f(void) {", "int x = ;", "int f(int a int b);", "int f(void) { a = 1 b = 2; }", "struct s { int a }", "int a[3;", "int f(void) { return 0; }}", "int f(void) { if a { } }", "int f(void) { for (;;; ) ; }", "int f(void) { else { } }", "int f(void) { case 1 a; }", "int x y;", "<<<<<<< HEAD", "=======", ">>>>>>> b", "int f(void) { x = (1 + ; }", "int f(void) { x + + ; }", "char *s = \"a;", "char c = 'a;", "/* open", "#if 1\nint x;", "#endif", "#else", "#elif 1", "#if\n#endif", "#ifdef\n#endif", "#if 1\n#else\n#else\n#endif",
        "class A { public: int b; };", "namespace a { }", "template <typename T> T f(T x);", "int x = a::b;", "def f():\n    pass", "import os", "{\"a\": 1}", "# Title\nsome words here", "x = [1, 2, 3]", "int f(void) { do { } }", "int f(void) { while () { } }", "int f(void) { switch (a) { case: } }", "enum { A B };", "int f(, int a);", "int a = {1, 2;", "int f(void) { return }", "int f(void) { goto ; }", "struct { int : ; };", "int f(void) { a ? b; }", "int (*f(int)[3];", "typedef int;;)", "int f(void) { sizeof; }", "int f(void) { a.; }", "int f(void) { a->1; }", "int f(void) { [a]; }", "static int", "int f(void) { int 3x; }", "int f(void) { return 0 }", "int f(void) int x; }", "public int f() { }", "int f(void) { x = 1,; }", "int f(void) { (a; }", "int f(void) { a); }", "int f(void) { break }", "#define\n", "#if 0\n#elif 1\n(\n#endif", "#ifndef X\nint f( {\n#endif", "int f(void) { \"a\" b \"c\" 1; }", "int a, , b;", "struct s v = { .a = };", "int f(void) { @ }", "int f(void) { $(a) }", "int `a`;", "int f(void) { x = y z; }", "int f(void) try { }",
    ],
    "c++": [
        "class A { int x }", "class A { };}", "namespace a {", "template <typename T T f();", "int f() { =======\n }", "class A : { };", "void f() { auto = 1; }", "void f() { for (auto x y) ; }", "void f() { try { } }", "void f() { catch (int e) { } }", "int x = new ;", "struct A { public int x; };", "template typename T> void f();", "using = int;", "enum class { A B };", "void f() { std::; }", "void f() { a::b:: ; }", "void f() { [x { return 1; }; }", "int operator+(;", "void f() { return return; }", "void f() { if (a) else }", "void f() { int x = 1 }", "def f(): pass", "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b", "struct A : public { };", "void f() { switch { } }", "auto l = [] { return 1; ;", "const int f() { delete; }", "class { int x; ", "void f() { a < ; }", "void f() { static_cast<int> x; }", "import os\n", "void f( { }", "virtual ~A( { }", "void f() { \"a; }", "int x = 'ab;", "template <> ;)", "void f() { x->; }", "class A { A() : { } };", "{ \"a\": 1 }", "extern \"C\" {", "void f() { do x; }", "void f() noexcept( { }", "#if 1\nvoid f();", "int a b c;", "friend;)", "void f() { co_await; }",
    ],
    "python": [
        "f(a=1, 2)\n", "x = 08\n", "def f(a=1, b): pass\n", "def f(*): pass\n", "def f(**k, a): pass\n", "lambda a=1, b: 0\n", "f(**a, *b)\n", "f(**a, b)\n", "f() = 1\n", "1 = x\n", "a + b = c\n", "del f()\n", "for f() in x: pass\n", "with a as f(): pass\n", "f() += 1\n", "(a, b) += 1\n", "x = \n", "def f(:\n    pass\n", "if x\n    y\n", "x = (1\n", "x = 1)\n", "def f():\nreturn 1\n", "  x = 1\n", "x = 1\n  y = 2\n", "print 'x'\n", "exec 'a'\n", "<<<<<<< a\nx = 1\n", "=======\n", ">>>>>>> b\n", "x = 'a\n", "x = '''a\n", "for x in y:\n", "class A\n    pass\n", "a = = 1\n", "else:\n    pass\n", "try:\n    pass\n", "try:\n    pass\nexcept:\n    pass\nexcept A:\n    pass\n", "try:\n    pass\nexcept A:\n    pass\nexcept* B:\n    pass\n", "import\n", "from a import\n", "from a import (b, c\n", "import a as b.c\n", "x = 1__0\n", "x = 0xG\n", "x = 0b12\n", "x = 1a\n", "f'{}'\n", "f'{a'\n", "f'}'\n", "f'{a b}'\n", "b'a' 'b'\n", "'\\x1'\n", "'\\u12'\n", "if x:\n\ta\n        b\n", "raise from a\n", "x = [1, 2\n", "x = {a: 1, b}\n", "x = {a, b: 1}\n", "a b\n", "def f(a, a=): pass\n", "lambda: \n", "not\n", "x = a if b\n", "@\ndef f(): pass\n", "return = 1\n", "x = yield = 1\n", "class = 1\n", "int x = 1;\n", "function f() {}\n", "// c\n", "/* a */\n", "{'a': 1,\n", "match x:\n    case a b:\n        pass\n", "async x = 1\n", "x ? y : z\n", "x++\n", "$x = 1\n", "a := 1\n", "def f() -> : pass\n", "while x\n", "assert\n", "del\n", "x = *\n", "f(,)\n", "from . import *, a\n", "global\n", "x[]\n", "x[1:2:3:4]\n", "type X\n",
    ],
}
