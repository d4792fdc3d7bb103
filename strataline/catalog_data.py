"""Fixed values of the built-in catalog: a subset of languages, those in wide use, with their markers and extensions. Where two
languages share an extension, the one further up is the default."""

# Fixed values: `== line markers == block pairs`, then languages with their extensions.
LANGUAGES = r"""
== // == // 1 /* */
Gradle : gradle
== # // == /* */
Elixir Script : exs
== // == { } (* *)
F# Script : fsx
== ; ==
INI : buildozer.spec editorconfig ini lektorproject prefs
ClojureC : cljc
ClojureScript : cljs
Racket : rkt rktd rktl scrbl
Scheme : sc sch scm sld sps ss
LLVM IR : ll
WebAssembly : wast wat
Clojure : clj cljs cljc edn
Lisp : lisp lsp el scm ss rkt
AutoHotkey : ahk ahkl
== // == /* */
JSON5 : json5
JSON : json jsonc json5
Protocol Buffers : proto
ReScript : res resi
ActionScript : as
Apex Trigger : trigger
JSX : jsx
LESS : less
Nemerle : n
Pkl : pkl
Stylus : styl
Typst : typ
lex : l lex
peg.js : pegjs
Modelica : mo
ANTLR Grammar : g g4
Arduino Sketch : ino
C/C++ Header : H h hh hpp hxx
Carbon : carbon
Chapel : chpl
CodeQL : ql qll
Dafny : dfy
Flatbuffers : fbs
GLSL : comp fp frag frg fsh fshader geo geom glsl glslv gshader tesc tese vert vrx vsh vshader
Haxe : hx hxsl
Objective-C++ : mm
Odin : odin
OpenSCAD : scad
Processing : pde
QML : qbs qml
Solidity : sol
Vala : vala
Verilog-SystemVerilog : sv svh
Xtend : xtend
yacc : y yacc
C# : cs
Dart : dart
Groovy : groovy gradle
Java : java
Kotlin : kt kts
Scala : scala sc
C : c h
C++ : cc cpp cxx c++ hh hpp hxx
CUDA : cu cuh
Go : go
HLSL : hlsl fx
Metal : metal
Rust : rs
Swift : swift
V : v vsh
Verilog : v sv svh
WGSL : wgsl
JavaScript : js jsx mjs cjs
SCSS : scss
TypeScript : ts tsx mts cts
== none == /* */
CSS : css
== # ==
Bazel : BUILD
Containerfile : Containerfile
Jam :
Justfile : just
Meson : meson.build
BitBake : bb bbappend bbclass inc
Dockerfile : dockerfile
Makefile : mk mak make
TOML : toml
YAML : yml yaml
Crystal : cr
Cucumber : feature
make : Gnumakefile Makefile am gnumakefile makefile mk
Perl : pl pm t
Awk : awk
Tcl : tcl
Bash : bash
Elixir : ex exs
GDScript : gd
R : r
Shell : sh zsh ksh
C Shell : csh tcsh
Fish Shell : fish
Nushell : nu
sed : sed
== # == #[[ ]]
CMake : cmake
== # // == /* */
Snakemake : rules smk
Starlark : bazel bzl
HCL : hcl tf tfvars
== # == \""" \""" ''' '''
Python : py pyw pyi
== # == \""" \"""
GraphQL : graphql gql
== # == =begin =end
Ruby : rb rake gemspec
== # == #= =#
Julia : jl
== # == <# #>
PowerShell : ps1 psm1 psd1
== # == ### ###
CoffeeScript : coffee
== # == #[ ]#
Nim : nim nims
== # == /* */
Nix : nix
== // # == /* */
PHP : php phtml php3 php4 php5
Thrift : thrift
Cython : pxd pxi pyx
== // == 
Zig : zig zon
Gleam : gleam
Prisma Schema : prisma
Pug : jade pug
== -- == {- -}
Agda : agda lagda
PureScript : purs
Elm : elm
Haskell : hs lhs
== -- == --[[ ]]
Lua : lua
== -- == /* */
SQL : sql
== -- // == /* */
VHDL : VHD VHDL vhd vhdl vhf vhi vho vhs vht vhw
== -- ==
Ada : adb ads
== none == (* *)
Standard ML : fun sig sml
Mathematica : cdf ma mathematica mt nbp wl wlt
OCaml : ml mli
== // == (* *)
F# : fs fsi fsx
== % ==
TeX : aux bbx bib bst cbx dtx ins lbx ltx mkii mkiv mkvi sty tex
Erlang : erl hrl
== % == %{ %}
MATLAB : m
== // == /* */
Objective-C : m mm
== ! C c * ==
Fortran : f for f90 f95 f03 f08
== * / ==
COBOL : cob cbl cpy
== REM :: ==
Batch : bat cmd
== none == <!-- -->
Ant/XML :
Maven/XML :
MSBuild script : btproj csproj msbuild vcproj wdproj wixproj
Property List : plist entitlements provisionprofile
DTD : dtd
Haml : haml
SVG : SVG svg
XAML : xaml
XHTML : xhtml
XSD : XSD xsd
XSLT : XSL XSLT xsl xslt
Markdown : md markdown mdx
XML : xml xhtml xaml svg
HTML : html htm
== // == <!-- --> /* */
JSP : jsp jspf
Vuejs Component : vue
== none == {{! }} {{!-- --}}
Handlebars : hbs
== none ==
CSV : csv
Jupyter Notebook : ipynb
diff : diff patch
m4 : ac m4
reStructuredText : rest rest.txt rst rst.txt
Visual Basic .NET : VB VBHTML vb vbhtml vbproj
Rich Text Format : rtf
Text : txt text conl version gitignore
""".replace('\\"', '"')

# Whole file names, first letters, last letters.
EXACT_NAMES = (
    ("Dockerfile", "Dockerfile"), ("Makefile", "Makefile"), ("GNUmakefile", "Makefile"), ("CMakeLists.txt", "CMake"), ("Cargo.lock", "TOML"),
    ("flake.lock", "JSON"), ("uv.lock", "TOML"), ("RELEASE_CHANNEL", "Text"), ("Procfile", "Shell"), ("OFL.txt", "Text"), ("build.xml", "Ant/XML"),
    ("BUILD", "Bazel"), ("WORKSPACE", "Bazel"), ("Containerfile", "Containerfile"), ("Jamfile", "Jam"), ("Jamrules", "Jam"), ("jamfile", "Jam"),
    ("Justfile", "Justfile"), ("justfile", "Justfile"), ("pom.xml", "Maven/XML"), ("meson.build", "Meson"), ("Snakefile", "Snakemake"),
)
NAME_PREFIXES = (("Dockerfile", "Dockerfile"), ("Procfile", "Shell"), ("LICENSE", "Text"), ("blame_incremental_", "Text"))
NAME_SUFFIXES = (("-pattern", "Text"), (".desktop.in", "Text"), (".yaml.in", "YAML"), (".xml.in", "XML"))

# Content rules (language, score, pattern with ^ at line starts and ASCII classes).
CONTENT_RULES = (
    ("MATLAB", 5, r"^\s*function\b"),
    ("MATLAB", 5, r"^\s*classdef\b"),
    ("MATLAB", 3, r"^\s*%\{"),
    ("Objective-C", 5, r"^\s*#\s*import\b"),
    ("Objective-C", 5, r"^\s*@(?:interface|implementation|protocol|end)\b"),
    ("Objective-C", 4, r"@autoreleasepool\b"),
    ("V", 5, r"^\s*fn\s+\w+"),
    ("V", 4, r"^\s*(pub\s+)?struct\s+\w+"),
    ("V", 3, r"^\s*import\s+[\w./]+"),
    ("Verilog", 6, r"^\s*endmodule\b"),
    ("Verilog", 4, r"^\s*(always|assign|wire|reg|logic|input|output|inout)\b"),
    ("Verilog", 3, r"^\s*module\s+\w+\s*(#|\()"),
)
#: Least score of content rules, and least lead over the second.
LEAST_SCORE, LEAST_LEAD = 4, 2

# Interpreters on a first line, in order, by substrings.
SHEBANGS = (("Python", ("python",)), ("JavaScript", ("node", "deno", "bun")), ("Shell", ("sh", "bash", "zsh", "ksh")))
