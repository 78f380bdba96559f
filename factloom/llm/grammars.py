"""Grammars of the script languages, as text for :mod:`derivatives`.

Rules are written for recognition: operators have precedence only where mixing them is an error. AWAITOP and
RETURNOP stand for the words that only some places allow; every rule that leads to them is copied for each kind of place:
as it is for module level, ``__a`` inside asynchronous functions, ``__p`` inside plain ones. What a later
phase of a compiler checks (types, scopes, labels, repeated declarations) is left out.
"""

from __future__ import annotations

import re

#: Words of ECMAScript that are never identifiers in a module.
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally
    for function if import in instanceof new null return super switch this throw true try typeof var void while with
    yield await let static implements interface package private protected public""".split()
)

#: Words with a meaning in some places which are identifiers elsewhere.
CONTEXTUAL = frozenset(
    """as async from get set of type declare namespace module abstract readonly is keyof infer unique asserts global
    satisfies out override accessor require assert target meta using""".split()
)

ID = CONTEXTUAL | {"IDENT"}
WORD = ID | RESERVED
#: An attribute may not be named so, which tells a generic arrow function from an element.
ATTRIBUTE = WORD - {"extends"}

SCRIPT = """
program = HASHBANG? item* EOF
term = ';' | ASI
item = stmt | importDecl | exportDecl
block = '{' stmt* '}'
stmt = block | ';' | varDecl | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' AWAITOP? '(' forHead ')' stmt | 'while' '(' expr ')' stmt
  | 'do' stmt 'while' '(' expr ')' (';' | ASI)? | ('continue' | 'break') ID? term | RETURNOP expr? term | 'throw' expr term
  | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}'
  | 'try' block ('catch' ('(' binding typeNote? ')')? block ('finally' block)? | 'finally' block) | 'debugger' term
  | ID ':' stmt | funcDecl | classDecl | -{{ function class} expr term | moreStmt
varDecl = ('var' | 'let') letBind (',' letBind)* term | 'const' constBind (',' constBind)* term | AWAITOP? 'using' useBind (',' useBind)* term
letBind = ID definite? typeNote? ('=' assign)? | pattern typeNote? '=' assign
constBind = binding typeNote? '=' assign
useBind = ID typeNote? '=' assign
forHead = ('var' | 'let' | 'const') binding typeNote? ('of' assign | 'in' expr) | ('var' | 'let') letBind (',' letBind)* ';' expr? ';' expr? | AWAITOP? 'using' ID typeNote? 'of' assign
  | 'const' constBind (',' constBind)* ';' expr? ';' expr? | -{ let var const } (target | patternTarget) ('of' assign | 'in' expr) | -{ let var const } expr? ';' expr? ';' expr?
funcDecl = 'async' 'function' '*'? ID asyncRest | 'function' '*'? ID funcRest
classDecl = decorators classHead ID classRest
funcRest = signature__p '{' stmt__p* '}'
asyncRest = signature__a '{' stmt__a* '}'
signature = typeParams? '(' params ')' returnNote?
params = (param (',' param)* ','?)?
param = decorators paramMods '...'? binding optional? typeNote? ('=' assign)? | thisParam
binding = ID | pattern
pattern = '{' (bindProp (',' bindProp)* ','?)? '}' | '[' ','* (bindElem (','+ bindElem)* ','*)? ']'
bindProp = '...' binding | propName ':' binding ('=' assign)? | ID ('=' assign)?
bindElem = '...'? binding ('=' assign)?
classRest = typeParams? ('extends' postfix)? implements? '{' member* '}'
member = ';' | 'static' '{' stmt__p* '}' | decorators memberMods ('async' '*'? memberName asyncMethodRest | '*'? memberName methodRest | ('get' | 'set') memberName methodRest | memberName fieldMark? typeNote? ('=' assign__p)? term) | moreMember
memberName = propName | PRIVATE
propName = WORD | STR | NUM | '[' assign ']'
expr = assign (',' assign)*
assign = arrow | 'yield' ('*'? assign)? | logic ('?' assign ':' assign)? | target ('=' | ASSIGN | '>' '>' '>'? '=') assign | patternTarget '=' assign
logic = bits ((LOGIC bits)+ | (NULLISH bits)+)?
bits = unary (binary unary | cast)*
binary = BINARY | '<' | '>' '>'? '>'? | '>' '=' | '+' | '-' | '*' | '/' | '|' | '&' | 'in' | 'instanceof'
unary = ('!' | TILDE | '+' | '-' | 'typeof' | 'void' | 'delete' | AWAITOP | assertion)+ update | update (POW unary)?
update = INC target | target INC | postfix
postfix = 'new'* primary suffix*
suffix = lastSuffix | OPTCHAIN (WORD | PRIVATE | '[' expr ']' | arguments | template | genericCall) | arguments | template | moreSuffix
lastSuffix = '.' (WORD | PRIVATE) | '[' expr ']'
target = ID | '(' target ')' | 'new'* primary suffix* lastSuffix | moreTarget
patternTarget = '{' (targetProp (',' targetProp)* ','?)? '}' | '[' ','* (targetElem (','+ targetElem)* ','*)? ']'
targetProp = '...' target | propName ':' targetElem | ID ('=' assign)?
targetElem = '...'? (target | patternTarget) ('=' assign)?
arguments = '(' (element (',' element)* ','?)? ')'
element = '...'? assign
primary = ID | 'this' | 'super' | NUM | STR | 'null' | 'true' | 'false' | REGEX | PRIVATE | template | '[' ','* (element (','+ element)* ','*)? ']'
  | object | '(' expr ')' | 'async' 'function' '*'? ID? asyncRest | 'function' '*'? ID? funcRest | decorators classHead ID? classRest
  | 'import' ('(' assign (',' assign)? ','? ')' | '.' WORD) | 'new' '.' WORD | moreElement
template = TFULL | THEAD expr (TMID expr)* TTAIL
object = '{' (prop (',' prop)* ','?)? '}'
prop = '...' assign | propName ':' assign | ID | 'async' '*'? propName asyncRest | '*'? propName funcRest | ('get' | 'set') propName funcRest
arrow = 'async' (ID | signature__a) '=>' body__a | (ID | signature) '=>' body__p
body = block | -{{} assign
importDecl = 'import' (STR | typeWord? (ID (',' (nameSpace | named))? | nameSpace | named) 'from' STR) attributes? term | importEquals
nameSpace = '*' 'as' ID
named = '{' (spec (',' spec)* ','?)? '}'
spec = typeWord? (WORD | STR) ('as' (WORD | STR))?
attributes = ('with' | 'assert') object
exportDecl = 'export' typeWord? ('*' ('as' (WORD | STR))? 'from' STR attributes? | named ('from' STR attributes?)?) term
  | 'export' 'default' ('async' 'function' '*'? ID? asyncRest | 'function' '*'? ID? funcRest | decorators classHead ID? classRest | -{ function class } assign term | moreDefault)
  | decorators 'export' (varDecl | funcDecl | classDecl) | moreExport
"""

#: The places where ECMAScript without types has nothing.
PLAIN = """
typeNote = NEVER
definite = NEVER
optional = NEVER
returnNote = NEVER
typeParams = NEVER
implements = NEVER
decorators = DECORATOR?
paramMods = DECORATOR?
thisParam = NEVER
memberMods = 'static'?
methodRest = funcRest
asyncMethodRest = asyncRest
moreTarget = NEVER
fieldMark = NEVER
moreMember = NEVER
moreStmt = NEVER
classHead = 'class'
cast = NEVER
assertion = NEVER
genericCall = NEVER
moreSuffix = NEVER
typeWord = NEVER
importEquals = NEVER
moreDefault = NEVER
moreExport = NEVER
"""

TYPED = """
typeNote = ':' type
definite = '!'
optional = '?'
returnNote = ':' returnType
implements = 'implements' type (',' type)*
decorators = ('@' postfix)*
paramMods = ('public' | 'private' | 'protected' | 'readonly' | 'override')*
thisParam = 'this' typeNote
memberMods = ('static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor')*
methodRest = '?'? signature__p ('{' stmt__p* '}' | term)
asyncMethodRest = '?'? signature__a ('{' stmt__a* '}' | term)
moreTarget = 'new'* primary suffix* '!' | '(' expr ')'
fieldMark = '?' | '!'
moreMember = ('static' | 'readonly')* indexSignature term
classHead = 'abstract'? 'class'
cast = 'as' (type | 'const') | 'satisfies' type
genericCall = typeArgs arguments
moreSuffix = '!' | typeArgs
typeWord = 'type'
importEquals = 'import' 'type'? ID '=' ('require' '(' STR ')' | ID ('.' WORD)*) term
moreDefault = interface
moreExport = 'export' (typeDecl | ambient | importEquals) | 'export' '=' expr term | 'export' 'as' 'namespace' ID term
moreStmt = typeDecl | ambient
typeDecl = interface | 'type' ID typeParams? '=' type term | 'const'? 'enum' ID '{' (enumItem (',' enumItem)* ','?)? '}'
  | ('namespace' | 'module') ID ('.' WORD)* '{' item* '}' | 'async'? 'function' '*'? ID signature term
enumItem = propName ('=' assign)?
interface = 'interface' ID typeParams? ('extends' type (',' type)*)? objectType
ambient = 'declare' ambientDecl
ambientDecl = ('var' | 'let' | 'const') ambientBind (',' ambientBind)* term | 'function' '*'? ID signature term | 'async' 'function' ID signature term
  | classDecl | typeDecl | ('module' STR | 'global') ('{' ambientItem* '}' | term) | ('namespace' | 'module') ID ('.' WORD)* '{' ambientItem* '}'
ambientBind = binding typeNote? ('=' assign)?
ambientItem = ';' | importDecl | exportDecl | 'export'? 'declare'? ambientDecl | -{{ function class} expr term
type = functionType | union ('extends' union '?' type ':' type)?
functionType = 'abstract'? 'new'? typeParams? '(' params ')' '=>' returnType
returnType = type | 'asserts'? (ID | 'this') 'is' type | 'asserts' (ID | 'this')
union = ('|' | '&')? operand (('|' | '&') operand)*
operand = ('keyof' | 'unique' | 'readonly')* (primType | 'infer' ID ('extends' union)?) ('[' type? ']')*
primType = '(' type ')' | ID ('.' WORD)* typeArgs? | STR | '-'? NUM | 'true' | 'false' | 'null' | 'this' | 'void' | templateType
  | 'typeof' ('import' '(' STR ')' | ID | 'this') ('.' (WORD | PRIVATE))* typeArgs? | 'import' '(' STR (',' object)? ')' ('.' WORD)* typeArgs? | objectType | mapped | tuple
templateType = TFULL | THEAD type (TMID type)* TTAIL
typeArgs = '<' type (',' type)* '>'
typeParams = '<' typeParam (',' typeParam)* ','? '>'
typeParam = ('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?
tuple = '[' (tupleItem (',' tupleItem)* ','?)? ']'
tupleItem = '...'? (WORD '?'? ':')? type '?'?
objectType = '{' (typeMember (';' | ',' | ASI))* typeMember? '}'
typeMember = 'readonly'? propName '?'? (typeNote | signature)? | ('get' | 'set') propName signature | 'new'? signature | 'readonly'? indexSignature
indexSignature = '[' ID ':' type ']' typeNote?
mapped = '{' (('+' | '-')? 'readonly')? '[' ID 'in' type ('as' type)? ']' (('+' | '-')? '?')? typeNote? (';' | ',' | ASI)? '}'
"""

#: Without elements a type may stand in angle brackets before an operand.
NO_ELEMENTS = """
moreElement = NEVER
"""

ELEMENTS = """
moreElement = jsx
jsx = '<' '>' child* '<' '/' '>' | '<' tagName typeArgs0 attribute* ('/' '>' | '>' child* '<' '/' tagName '>')
tagName = (WORD | JSXNAME) (':' (WORD | JSXNAME) | ('.' (WORD | JSXNAME))*)
attribute = '{' '...' assign '}' | (ATTRIBUTE | JSXNAME) (':' (WORD | JSXNAME))? ('=' (JSXSTR | '{' assign '}' | jsx))?
child = JSXTEXT | '{' ('...'? expr)? '}' | jsx
"""


def script_grammar(typed: bool, elements: bool) -> str:
    """ECMAScript modules, with types and with elements as asked."""
    text = SCRIPT.strip() + "\n" + (TYPED if typed else PLAIN).strip() + "\n" + (ELEMENTS if elements else NO_ELEMENTS).strip()
    if typed:
        text += "\nassertion = " + ("NEVER" if elements else "'<' (type | 'const') '>'")
    if elements:
        text += "\ntypeArgs0 = " + ("typeArgs?" if typed else "NEVER?")
    return _places(text)


_REFERENCE = re.compile(r"'[^']*'|-\{[^}]*\}|[A-Za-z_]\w*")


def _places(text: str) -> str:
    """Copies of the rules that lead to AWAITOP or RETURNOP for module level, asynchronous and plain functions."""
    rules = dict(line.split(" = ", 1) for line in re.sub(r"\n\s+", " ", text.strip()).splitlines())
    uses = {name: set(_REFERENCE.findall(body)) for name, body in rules.items()}
    leads = {name for name, words in uses.items() if words & {"AWAITOP", "RETURNOP"}}
    while more := {name for name, words in uses.items() if name not in leads and words & leads}:
        leads |= more
    out = [f"{name} = {body}" for name, body in rules.items() if name not in leads]
    for suffix, awaits, returns in (("", True, False), ("__a", True, True), ("__p", False, True)):
        words = {"AWAITOP": "'await'" if awaits else "NEVER", "RETURNOP": "'return'" if returns else "NEVER"} | {n: n + suffix for n in leads}
        out += [f"{name}{suffix} = " + _REFERENCE.sub(lambda m: words.get(m[0], m[0]), rules[name]) for name in sorted(leads)]
    return "\n".join(out)


JSON = """
document = value EOF
value = '{' (STR ':' value (',' STR ':' value)*)? '}' | '[' (value (',' value)*)? ']' | STR | NUM | 'true' | 'false' | 'null'
"""

#: The keywords of Python.
PYTHON_KEYWORDS = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global
    if import in is lambda nonlocal not or pass raise return try while with yield""".split()
)
#: Words which are keywords only in some statements.
PYTHON_SOFT = frozenset("match case type _".split())
NAME = PYTHON_SOFT | {"IDENT"}

PYTHON = """
file = (NEWLINE | stmt)* EOF
stmt = simple | compound
simple = small (';' small)* ';'? NEWLINE
suite = simple | NEWLINE INDENT stmt+ DEDENT
small = assignment | 'del' targets | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)? | ('global' | 'nonlocal') NAME (',' NAME)*
  | 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* | 'from' ('.' | '...')* dotted? 'import' importNames | 'assert' test (',' test)? | 'type' NAME typeParams? '=' test
importNames = '*' | '(' importAs (',' importAs)* ','? ')' | importAs (',' importAs)*
importAs = NAME ('as' NAME)?
dotted = NAME ('.' NAME)*
assignment = stars | yield | (targets '=')+ value | single (':' test ('=' value)? | AUGMENT value)
value = yield | stars
yield = 'yield' ('from' test | stars)?
compound = decorated | 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)?
  | 'async'? 'for' targets 'in' stars ':' suite ('else' ':' suite)? | 'try' ':' suite (('except' '*'? (tests ('as' NAME)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
  | 'async'? 'with' withItems ':' suite | 'match' stars ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' suite)+ DEDENT
decorated = ('@' named NEWLINE)* ('async'? 'def' NAME typeParams? '(' params ')' ('->' test)? ':' suite | 'class' NAME typeParams? ('(' callArgs ')')? ':' suite)
typeParams = '[' typeParam (',' typeParam)* ','? ']'
typeParam = ('*' | '**')? NAME (':' test)? ('=' test)?
withItems = withItem (',' withItem)* | '(' withItem (',' withItem)* ','? ')'
withItem = test ('as' starTarget)?
tests = test (',' test)*
targets = starTarget (',' starTarget)* ','?
starTarget = '*'? single
single = NAME | '(' targets? ')' | '[' targets? ']' | atom trailer* ('.' NAME | '[' subscripts ']')
params = (param (',' param)* ','?)?
param = ('*' | '**')? NAME (':' '*'? test)? ('=' test)? | '*' | '/'
stars = star (',' star)* ','?
star = '*' orExpr | named
named = test | NAME ':=' test
test = logic ('if' logic 'else' test)? | 'lambda' lambdaParams ':' test
lambdaParams = (lambdaParam (',' lambdaParam)* ','?)?
lambdaParam = ('*' | '**')? NAME ('=' test)? | '*' | '/'
logic = 'not'* comparison (('and' | 'or') 'not'* comparison)*
comparison = orExpr ((COMPARE | 'in' | 'not' 'in' | 'is' 'not'?) orExpr)*
orExpr = unary ((OPERATOR | '*' | '**' | '-' | '+' | '/' | '@') unary)*
unary = ('+' | '-' | '~')* 'await'? primary
primary = atom trailer*
trailer = '(' callArgs ')' | '[' subscripts ']' | '.' NAME
callArgs = (callArg (',' callArg)* ','?)?
callArg = named comp? | NAME '=' test | ('*' | '**') test
subscripts = subscript (',' subscript)* ','?
subscript = star | test? ':' test? (':' test?)?
atom = NAME | NUM | strings | 'None' | 'True' | 'False' | '...' | '(' (yield | star (comp | (',' star)* ','?))? ')' | '[' (star (comp | (',' star)* ','?))? ']' | '{' (dictItems | setItems)? '}'
dictItems = pair (comp | (',' pair)* ','?)
pair = test ':' test | '**' orExpr
setItems = star (comp | (',' star)* ','?)
comp = ('async'? 'for' targets 'in' logic ('if' compIf)*)+
compIf = logic | NAME ':=' test
strings = (STR | fstring)+
fstring = FSTART fpart* FEND
fpart = FMIDDLE | '{' value '='? ('!' NAME)? (':' fpart*)? '}'
patterns = asPattern (',' asPattern)* ','?
asPattern = orPattern ('as' NAME)? | '*' NAME
orPattern = closed ('|' closed)*
closed = '-'? NUM (('+' | '-') NUM)? | strings | 'None' | 'True' | 'False' | NAME ('.' NAME)* ('(' (patternArg (',' patternArg)* ','?)? ')')?
  | '(' patterns? ')' | '[' patterns? ']' | '{' (mapItem (',' mapItem)* ','?)? '}'
patternArg = (NAME '=')? asPattern
mapItem = '**' NAME | ('-'? NUM | strings | 'None' | 'True' | 'False' | NAME ('.' NAME)+) ':' asPattern
"""
