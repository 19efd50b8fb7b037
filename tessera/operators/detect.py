"""Languages, frameworks and kinds of code bases, from paths and the texts of two manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import suffix

#: Language -> extensions.
EXTENSIONS = {
    "python": ["py", "pyx", "pyi"], "javascript": ["js", "mjs", "cjs"], "typescript": ["ts", "tsx"], "java": ["java"], "kotlin": ["kt", "kts"], "scala": ["scala"], "go": ["go"], "rust": ["rs"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"],
    "csharp": ["cs"], "fsharp": ["fs", "fsx"], "vb": ["vb"], "php": ["php"], "ruby": ["rb"], "swift": ["swift"], "dart": ["dart"], "r": ["r"], "julia": ["jl"], "perl": ["pl", "pm"], "lua": ["lua"], "shell": ["sh", "bash", "zsh", "fish"], "powershell": ["ps1"],
    "elixir": ["ex", "exs"], "erlang": ["erl"], "haskell": ["hs"], "clojure": ["clj", "cljs"], "elm": ["elm"], "ocaml": ["ml", "mli"], "nim": ["nim"], "zig": ["zig"], "d": ["d"], "groovy": ["groovy"], "matlab": ["m"],
}
#: Framework -> names of files that show it. A name is compared with the file's own name, so one with a slash
#: never matches.
FRAMEWORKS = {
    "django": ["manage.py", "settings.py", "wsgi.py"], "flask": ["app.py", "application.py"], "fastapi": ["main.py"], "poetry": ["pyproject.toml"], "uv": ["uv.lock", ".python-version"], "pipenv": ["Pipfile"], "conda": ["environment.yml", "environment.yaml"],
    "nodejs": ["package.json"], "npm": ["package-lock.json"], "yarn": ["yarn.lock"], "pnpm": ["pnpm-lock.yaml"], "react": ["package.json"], "vue": ["vue.config.js", "nuxt.config.js"], "angular": ["angular.json"], "svelte": ["svelte.config.js"], "next": ["next.config.js"],
    "gatsby": ["gatsby-config.js"], "webpack": ["webpack.config.js"], "vite": ["vite.config.js", "vite.config.ts"], "rollup": ["rollup.config.js"], "parcel": [".parcelrc"], "maven": ["pom.xml"], "gradle": ["build.gradle", "build.gradle.kts", "gradlew"],
    "spring": ["application.properties", "application.yml"], "android": ["AndroidManifest.xml"], "dotnet": ["*.csproj", "*.fsproj", "*.vbproj", "*.sln"], "nuget": ["packages.config"], "go_modules": ["go.mod", "go.sum"], "cargo": ["Cargo.toml", "Cargo.lock"],
    "bundler": ["Gemfile", "Gemfile.lock"], "rails": ["config/application.rb"], "composer": ["composer.json", "composer.lock"], "laravel": ["artisan"], "swift_package": ["Package.swift"], "xcode": ["*.xcodeproj", "*.xcworkspace"], "flutter": ["pubspec.yaml"],
    "r_package": ["DESCRIPTION", "NAMESPACE"], "docker": ["Dockerfile", "docker-compose.yml", "docker-compose.yaml"], "github_actions": [".github/workflows"], "gitlab_ci": [".gitlab-ci.yml"], "jenkins": ["Jenkinsfile"], "travis": [".travis.yml"],
    "circleci": [".circleci/config.yml"], "sphinx": ["conf.py", "docs/conf.py"], "mkdocs": ["mkdocs.yml"], "gitbook": ["book.json", ".gitbook.yaml"], "jekyll": ["_config.yml"], "pytest": ["pytest.ini", "pyproject.toml"], "jest": ["jest.config.js"],
    "mocha": [".mocharc.json"], "karma": ["karma.conf.js"], "eslint": [".eslintrc.js", ".eslintrc.json", "eslint.config.js"], "prettier": [".prettierrc", "prettier.config.js"], "black": ["pyproject.toml"], "flake8": [".flake8", "setup.cfg"],
    "mypy": ["mypy.ini", "pyproject.toml"], "ruff": ["ruff.toml", "pyproject.toml"],
}
#: Framework -> dependencies in package.json, and framework -> parts of pyproject.toml.
DEPENDENCIES = {"react": ["react", "react-dom"], "vue": ["vue"], "angular": ["@angular/core"], "svelte": ["svelte"], "next": ["next"], "gatsby": ["gatsby"], "webpack": ["webpack"], "vite": ["vite"], "jest": ["jest"], "eslint": ["eslint"], "prettier": ["prettier"]}
SECTIONS = {"poetry": ["[tool.poetry]"], "uv": ["[tool.uv]", 'build-backend = "uv_build"'], "black": ["[tool.black]"], "mypy": ["[tool.mypy]"], "ruff": ["[tool.ruff]"], "pytest": ["[tool.pytest]"]}
#: What decides the kind of a code base, in order.
FRONTEND, MOBILE, NOTEBOOKS, PACKAGES = ["react", "vue", "angular", "svelte", "next", "gatsby"], ["flutter", "android", "xcode"], ["jupyter", "conda"], ["poetry", "uv", "cargo", "maven", "gradle", "composer"]
SCRIPTS, DESKTOP, SYSTEM = ["javascript", "typescript"], ["csharp", "java", "cpp", "swift"], ["rust", "go", "c"]


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def language(path: Column) -> Column:
    """The language of a file by its extension, null where it is none of EXTENSIONS."""
    return F.create_map(*(F.lit(x) for name, ends in EXTENSIONS.items() for e in ends for x in (e, name)))[suffix(path)]


def language_counts(files: DataFrame, repo: str) -> DataFrame:
    """repo, language, n of the files (path) with a known language."""
    return files.select(repo, language(F.col("path")).alias("language")).where("language is not null").groupBy(repo, "language").agg(F.count(F.lit(1)).alias("n"))


def by_file(files: DataFrame, repo: str) -> DataFrame:
    """repo, framework of the files' names (path): equal to a marker, or matching one with a star."""
    rules = [(f, x) for f, names in FRAMEWORKS.items() for x in names]
    named = files.select(repo, F.element_at(F.split("path", "/"), -1).alias("name"))
    exact = F.broadcast(files.sparkSession.createDataFrame([r for r in rules if "*" not in r[1]], "framework string, name string"))  # fixed values
    globs = F.array_compact(F.array(*(F.when(F.col("name").endswith(x[1:]), f) for f, x in rules if "*" in x)))
    return named.join(exact, "name").select(repo, "framework").unionByName(named.select(repo, F.explode(globs).alias("framework"))).distinct()


def by_content(files: DataFrame, repo: str) -> DataFrame:
    """repo, framework of what package.json and pyproject.toml say (path, text); a manifest that does not parse says nothing."""
    name, text = F.element_at(F.split("path", "/"), -1), F.col("text")
    keys = lambda k: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{k}"), "map<string,string>")), F.array().cast("array<string>"))
    has = F.array_union(keys("dependencies"), keys("devDependencies"))
    deps = F.array_compact(F.array(*(F.when(F.arrays_overlap(has, strings(x)), f) for f, x in DEPENDENCIES.items())))
    parts = F.array_compact(F.array(*(F.when(F.greatest(*(F.contains(text, F.lit(s)) for s in x), F.lit(False)), f) for f, x in SECTIONS.items())))
    found = files.where(name.isin("package.json", "pyproject.toml")).select(repo, F.explode(F.when(name == "package.json", deps).otherwise(parts)).alias("framework"))
    return found.distinct()


def codebase_type(primary: Column, frameworks: Column) -> Column:
    """The kind of a code base by its most frequent language (null: unknown) and its frameworks."""
    any_of = lambda x: F.arrays_overlap(frameworks, strings(x))
    return (
        F.when(primary.isNull(), "unknown").when(any_of(FRONTEND), "web_frontend").when(any_of(["nodejs"]) | primary.isin(SCRIPTS), "web_backend").when(any_of(MOBILE), "mobile")
        .when((primary == "python") & any_of(NOTEBOOKS), "data_science").when(primary.isin(DESKTOP), "desktop").when(primary.isin(SYSTEM), "system").when(any_of(PACKAGES), "library").otherwise(primary)
    )


def summary(files: DataFrame, repo: str) -> DataFrame:
    """repo, primary, frameworks (sorted), kind of each repository. files: repo, path, text."""
    counts = language_counts(files, repo).groupBy(repo).agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("m")).select(repo, F.col("m.language").alias("primary"))
    found = by_file(files, repo).unionByName(by_content(files, repo)).groupBy(repo).agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))  # at most one of each
    out = files.select(repo).distinct().join(counts, repo, "left").join(found, repo, "left").withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<string>")))
    return out.withColumn("kind", codebase_type(F.col("primary"), F.col("frameworks")))
