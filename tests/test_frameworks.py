import pytest
from pyspark.sql import functions as F

from loomgraph.sources import files, frameworks

SAMPLES = [
    ("laravel", "php", "Route::get('/users', [UserController::class, 'index']);", ("/users", "UserController")),
    ("express", "javascript", "router.post('/login', auth, handler)", ("/login", "handler")),
    ("nestjs", "typescript", "@Get('cats')\n  async findAll() {", ("cats", "findAll")),
    ("django", "python", "path('home/', views.home, name='h')", ("home/", "views.home")),
    ("flask", "python", "@app.route('/x', methods=['GET'])\ndef show():", ("/x", "show")),
    ("fastapi", "python", "@router.get('/items/{i}')\nasync def item(i):", ("/items/{i}", "item")),
    ("rails", "ruby", "  get '/about', to: 'pages#about'", ("/about", "pages#about")),
    ("spring", "java", '@GetMapping("/hi")\n  public String hi() {', ("/hi", "hi")),
    ("play", "scala", "GET  /list  controllers.App.list", ("/list", "controllers.App.list")),
    ("go-web", "go", 'r.GET("/ping", mw, Ping)', ("/ping", "Ping")),
    ("rust-web", "rust", '#[get("/r")]\nasync fn root() {', ("/r", "root")),
    ("aspnet", "csharp", '[HttpGet("v")]\n  public IActionResult Show(', ("v", "Show")),
    ("vue", "vue", "{ path: '/a', component: Home }", ("/a", "Home")),
    ("vapor", "swift", 'app.get("hello", use: greet)', ("hello", "greet")),
    ("swiftui", "swift", "struct Card: View {", ("Card", None)),
    ("expo-modules", "kotlin", 'Name("Cam")', ("Cam", None)),
]


@pytest.mark.parametrize("name, language, text, want", SAMPLES, ids=[s[0] for s in SAMPLES])
def test_packs(name, language, text, want):
    (rule,) = [p.rule() for p in frameworks.PACKS if p.name == name]
    assert language in rule.languages
    nodes, refs = rule.extract("f", text)
    assert want[0] in [n for _, n, _ in nodes] and (want[1] is None or want[1] in [n for n, _, _ in refs])


def test_install_replaces_by_name():
    before = len(files.rules())
    frameworks.install(("flask",))
    frameworks.install(("flask",))
    assert len(files.rules()) == before + 1


def test_names_and_types(spark):
    df = spark.createDataFrame([("tableViewWithStyle:",), ("setName:",), ("plain",)], "s string")
    got = [tuple(r) for r in df.select(frameworks.selector_base(F.col("s")), frameworks.setter_property(F.col("s"))).collect()]
    assert got == [("tableView", None), ("setName", "name"), ("plain", None)]
    src = spark.createDataFrame([("f", "Box b = new Box(); let c: Cat = x; d = Dog(1); List<String> items;")], "id string, text string")
    assert {(r["receiver"], r["type_name"]) for r in frameworks.receiver_types(src).collect()} >= {("b", "Box"), ("c", "Cat"), ("d", "Dog"), ("items", "List")}
    routes = spark.createDataFrame([("a", "x"), ("b", "/y/")], "path string, name string")
    assert {r["name"] for r in frameworks.prefixed_routes(routes, spark.createDataFrame([("a", "/api/")], "path string, prefix string")).collect()} == {"/api/x", "/y"}
