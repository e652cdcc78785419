"""Bundled grammars, in one notation.

``name = expression``: terminals are quoted or, as classes of tokens, in capitals; ``|`` is ordered choice, ``? * +`` repeat,
``&`` and ``!`` look ahead, parentheses group, END is the end of the tokens. A capitalised name on the left stands for any one of
the listed terminals. Precedence of operators plays no part in validity, so that expressions are flat chains of operands.
"""

JSON = """
file = value END
value = STR | NUM | 'true' | 'false' | 'null' | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']'
pair = STR ':' value
"""

PYTHON = """
SIMPLE = NUM STR NAME
STOP = ',' ')' ']' '}'
NAME = ID 'match' 'case' 'type'
BIN = '+' '-' '*' '/' '//' '%' '@' '&' '|' '^' '<<' '>>' '**' '<' '>' '<=' '>=' '==' '!=' 'and' 'or' 'in'
PRE = '-' '+' '~' 'not' 'await'
AUG = '+=' '-=' '*=' '/=' '//=' '%=' '@=' '&=' '|=' '^=' '<<=' '>>=' '**='
CONST = NUM 'None' 'True' 'False' '...'
file = NL* stmt* END
stmt = compound | matching | simple
simple = small (';' small)* ';'? NL
small = 'return' exprs? | 'pass' | 'break' | 'continue' | 'del' exprs | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') NAME (',' NAME)* | 'assert' expr (',' expr)? | imports | alias | assign | exprs
alias = 'type' NAME typeparams? '=' expr
assign = target ':' expr ('=' rhs)? | (targets '=')+ rhs | target AUG rhs
rhs = yielding | exprs
yielding = 'yield' ('from' expr | exprs)?
targets = starred (',' starred)* ','?
starred = '*'? target
target = atom (call* access)+ | NAME | '(' targets? ')' | '[' targets? ']'
call = '(' args? ')'
access = '.' NAME | '[' slices ']'
imports = 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | '(' names ','? ')' | names)
names = NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
dotted = NAME ('.' NAME)*
exprs = SIMPLE ',' (SIMPLE ',')* (starexpr (',' starexpr)* ','?)? | starexpr (',' starexpr)* ','? | yielding
starexpr = SIMPLE &STOP | '*' expr | named
named = NAME ':=' expr | expr
expr = 'lambda' params? ':' expr | chain ('if' chain 'else' expr)?
chain = unit (binary unit)*
binary = BIN | 'not' 'in' | 'is' 'not'?
unit = PRE* atom trailer*
trailer = call | access
atom = NAME | STR+ | CONST | '(' (yielding | comp | exprs)? ')' | '[' (comp | exprs)? ']' | '{' (dict | comp | exprs)? '}'
comp = starexpr loops
loops = ('async'? 'for' targets 'in' chain ('if' named_chain)*)+
named_chain = NAME ':=' chain | chain
dict = entry (loops | (',' entry)* ','?)
entry = SIMPLE ':' SIMPLE &STOP | '**' chain | expr ':' expr
args = arg (',' arg)* ','?
arg = SIMPLE &STOP | '**' expr | '*' expr | NAME '=' expr | named loops?
slices = slice (',' slice)* ','?
slice = expr? ':' expr? (':' expr?)? | '*' expr | named
params = param (',' param)* ','?
param = '/' | '**' NAME | '*' NAME? | NAME ('=' expr)?
tparams = tparam (',' tparam)* ','?
tparam = '/' | '**' NAME (':' expr)? | '*' (NAME (':' '*'? expr)?)? | NAME (':' expr)? ('=' expr)?
typeparams = '[' ('*' | '**')? NAME (':' expr)? ('=' expr)? (',' ('*' | '**')? NAME (':' expr)? ('=' expr)?)* ','? ']'
block = ':' (NL suite | simple)
suite = IND stmt+ DED
compound = 'if' named block ('elif' named block)* ('else' block)? | 'async'? 'for' targets 'in' exprs block ('else' block)? | 'while' named block ('else' block)? | trying | 'async'? 'with' withs block | ('@' named NL)* (function | class)
trying = 'try' block (('except' '*'? (expr (',' expr)* ('as' NAME)?)? block)+ ('else' block)? ('finally' block)? | 'finally' block)
withs = '(' withitem (',' withitem)* ','? ')' &':' | withitem (',' withitem)*
withitem = expr ('as' target)?
function = 'async'? 'def' NAME typeparams? '(' tparams? ')' ('->' expr)? block
class = 'class' NAME typeparams? ('(' args? ')')? block
matching = 'match' exprs ':' NL cases
cases = IND ('case' patterns ('if' named)? block)+ DED
patterns = pattern (',' pattern)* ','?
pattern = '*' NAME | pat ('|' pat)* ('as' NAME)?
pat = STR+ | '-'? NUM (('+' | '-') NUM)? | CONST | dotted ('(' (keypat (',' keypat)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (('**' NAME | (STR+ | '-'? NUM | CONST | dotted) ':' pattern) (',' ('**' NAME | (STR+ | '-'? NUM | CONST | dotted) ':' pattern))* ','?)? '}'
keypat = NAME '=' pattern | pattern
"""

GO = """
SIMPLE = LIT ID
STOP = ',' ')' ']' '}' ';'
BIN = '+' '-' '*' '/' '%' '&' '|' '^' '<<' '>>' '&^' '==' '!=' '<' '<=' '>' '>=' '&&' '||'
PRE = '+' '-' '!' '^' '*' '&' '<-'
ASSIGN = '=' ':=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '&^='
LIT = NUM STR
file = ';'* 'package' ID ';' ';'* (import ';' ';'*)* (decl (';' ';'* | END))* END
import = 'import' (spec | '(' ';'* (spec (';' | &')') ';'*)* ')')
spec = ('.' | ID)? STR
decl = function | declaration
declaration = ('var' | 'const') (varspec | '(' ';'* (varspec (';' | &')') ';'*)* ')') | 'type' (typespec | '(' ';'* (typespec (';' | &')') ';'*)* ')')
varspec = ID (',' ID)* ('=' exprs | type ('=' exprs)?)?
typespec = ID (tparams !'=')? '='? type
tparams = '[' ID (',' ID)* constraint (',' ID (',' ID)* constraint)* ','? ']'
constraint = '~'? type ('|' '~'? type)*
function = 'func' params? ID tparams? signature block?
signature = params (params | type)?
params = '(' (param (',' param)* ','?)? ')'
param = ID '...'? type &(',' | ')') | '...'? type
type = 'func' signature | '*' type | '[' (']' | '...' ']' | expr ']') type | 'map' '[' type ']' type | '<-' 'chan' type | 'chan' '<-'? type | 'struct' struct_body | 'interface' interface_body | '(' type ')' | qualified
struct_body = '{' ';'* (field (';' | &'}') ';'*)* '}'
interface_body = '{' ';'* (method (';' | &'}') ';'*)* '}'
qualified = ID ('.' ID)? ('[' type (',' type)* ','? ']')?
field = ('*'? qualified | ID (',' ID)* type) &(STR | ';' | '}' | END) STR? | ID (',' ID)* type STR?
method = ID signature | constraint
block = '{' stmts '}'
stmts = ';'* (stmt (';' ';'* | &('}' | 'case' | 'default' | END)))*
stmt = block | declaration | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | if | for | switch | select | ('go' | 'defer') expr | ID ':' !'=' ';'* stmt? | simple
simple = exprs (ASSIGN ('range' expr | exprs) | '++' | '--' | '<-' expr)?
hsimple = hexprs (ASSIGN ('range' hexpr | hexprs) | '++' | '--' | '<-' hexpr)?
if = 'if' (hsimple? ';' hexpr | hexpr) block ('else' (if | block))?
for = 'for' ('range' hexpr | hsimple? ';' hexpr? ';' hsimple? | hsimple)? block
switch = 'switch' (hsimple? ';' (hsimple)? | hsimple)? switch_body
switch_body = '{' ';'* (('case' (types | exprs) | 'default') ':' stmts)* '}'
types = type (',' type)* &':'
select = 'select' select_body
select_body = '{' ';'* (('case' simple | 'default') ':' stmts)* '}'
exprs = expr (',' expr)*
hexprs = hexpr (',' hexpr)*
expr = SIMPLE &STOP | unary (BIN unary)*
hexpr = hunary (BIN hunary)*
unary = PRE* primary
hunary = PRE* hprimary
primary = operand trailer*
hprimary = hoperand htrailer*
operand = LIT | 'func' signature block? | '(' (expr | type) ')' | composite | type
hoperand = LIT | 'func' signature block? | '(' (expr | type) ')' | &('[' | 'map' | 'struct') composite | type
composite = littype literal
littype = 'map' '[' type ']' type | '[' (']' | '...' ']' | expr ']') type | 'struct' struct_body | qualified
literal = '{' ';'* (element (',' ';'* element)* ','?)? ';'* '}'
element = value (':' value)?
value = literal | expr
trailer = '.' (ID | '(' ('type' | type) ')') | index | '(' (arg (',' arg)* '...'? ','?)? ')'
htrailer = trailer
arg = expr | type
index = '[' (expr? ':' expr? (':' expr?)? | (expr | type) (',' (expr | type))* ','?) ']'
"""
#: Lines that begin with ``ts:`` belong to TypeScript alone, those with ``js:`` to JavaScript alone.
ECMASCRIPT = """
SIMPLE = LIT NAME
STOP = ',' ')' ']' '}' ';'
NAME = ID 'async' 'get' 'set' 'static' 'of' 'from' 'as' 'type' 'interface' 'namespace' 'declare' 'abstract' 'readonly' 'public' 'private' 'protected' 'override' 'is' 'keyof' 'infer' 'unique' 'asserts' 'satisfies' 'module' 'global' 'accessor' 'await' 'yield' 'let' 'implements' 'require' 'out'
ANY = NAME 'break' 'case' 'catch' 'class' 'const' 'continue' 'debugger' 'default' 'delete' 'do' 'else' 'enum' 'export' 'extends' 'false' 'finally' 'for' 'function' 'if' 'import' 'in' 'instanceof' 'new' 'null' 'return' 'super' 'switch' 'this' 'throw' 'true' 'try' 'typeof' 'var' 'void' 'while' 'with'
BIN = '+' '-' '*' '/' '%' '**' '&' '|' '^' '<<' '<' '<=' '>=' '==' '!=' '===' '!==' '&&' '||' '??' 'in' 'instanceof' '=' '+=' '-=' '*=' '/=' '%=' '**=' '&=' '|=' '^=' '<<=' '&&=' '||=' '??='
PRE = '+' '-' '!' '~' '++' '--' 'typeof' 'void' 'delete' 'new' 'await'
LIT = NUM STR TPL REGEX 'this' 'super' 'true' 'false' 'null'
file = N* stmt* END
stmt = (block | variable semi | function | class | if | for | while | 'do' N* stmt N* 'while' '(' expr ')' ';'? | switch | try | 'return' (!N expr)? semi | 'throw' expr semi | ('break' | 'continue') NAME? semi | 'debugger' semi | import | export | extra | ';' | NAME ':' N* stmt | expr semi) N*
semi = ';' | N | &'}' | END
js:extra = NEVER
ts:extra = ('declare' | 'abstract')* (interface | alias | enum | namespace | class) | 'declare' (variable semi | signature semi) | signature semi
ts:interface = 'interface' NAME tparams? ('extends' types)? object_type
ts:alias = 'type' NAME tparams? '=' type semi
ts:enum = 'const'? 'enum' NAME enum_body
ts:enum_body = '{' (N* key ('=' assign)? N* (',' | &'}'))* N* '}'
ts:namespace = ('namespace' | 'module' | 'global') (NAME ('.' NAME)* | STR)? block
ts:signature = 'async'? 'function' '*'? NAME? tparams? '(' params? ')' (':' result)?
block = '{' N* stmt* '}'
variable = ('let' | 'const' | 'var') declarator (',' declarator)*
declarator = binding annotation? ('=' assign)?
js:annotation = NEVER
ts:annotation = '!'? ':' type
binding = NAME | '[' (','* element)* ','* ']' | pattern
pattern = '{' (property (',' property)* ','?)? '}'
element = '...'? binding ('=' assign)? (',' | &']')
property = '...' NAME | key ':' binding ('=' assign)? | NAME ('=' assign)?
key = ANY | STR | NUM | '[' assign ']' | PRIVATE
function = 'async'? 'function' '*'? NAME? tparams? '(' params? ')' returns? block
js:returns = NEVER
ts:returns = ':' result
js:tparams = NEVER
ts:tparams = '<' tparam (',' tparam)* ','? '>'
ts:tparam = ('const' | 'in' | 'out')* NAME ('extends' type)? ('=' type)?
params = param (',' param)* ','?
js:param = '...'? binding ('=' assign)?
ts:param = decorator* (('public' | 'private' | 'protected' | 'readonly' | 'override') &(NAME | pattern | '['))* '...'? (binding | 'this') '?'? annotation? ('=' assign)?
decorator = '@' (NAME | '(' expr ')') ('.' ANY | '(' args? ')')* N*
class = decorator* ('export' 'default'?)? 'abstract'? 'class' (!('extends' | 'implements') NAME)? tparams? ('extends' postfix)? implementing? class_body
class_body = '{' (member | N | ';')* '}'
js:implementing = NEVER
ts:implementing = 'implements' types
member = decorator* ('static' block | (MODIFIER &(key | '*' | N key))* ('*'? key '?'? tparams? '(' params? ')' returns? (block | bodiless) | key ('?' | '!')? annotation? ('=' assign)? semi | indexed))
MODIFIER = 'static' 'async' 'get' 'set' 'public' 'private' 'protected' 'readonly' 'abstract' 'override' 'declare' 'accessor'
js:bodiless = NEVER
ts:bodiless = semi
js:indexed = NEVER
ts:indexed = '[' NAME ':' type ']' ':' type semi
if = 'if' '(' expr ')' N* stmt ('else' N* stmt)?
for = 'for' 'await'? '(' (('let' | 'const' | 'var') binding annotation? ('of' | 'in') expr | postfix ('of' | 'in') expr | (variable | expr)? ';' expr? ';' expr?) ')' N* stmt
while = 'while' '(' expr ')' N* stmt
switch = 'switch' '(' expr ')' switch_body
switch_body = '{' N* (('case' expr | 'default') ':' N* stmt*)* '}'
try = 'try' block N* ('catch' ('(' binding annotation? ')')? block N* ('finally' block)? | 'finally' block)
import = 'import' (STR | '.' ANY trailer* (BIN assign)? | '(' args ')' trailer* | clause 'from' STR | NAME '=' expr) (('with' | 'assert') object)? semi
js:clause = NAME (',' (named | star))? | named | star
ts:clause = ('type' !('from' STR))? (NAME (',' (named | star))? | named | star)
star = '*' 'as' NAME
named = '{' (spec (',' spec)* ','?)? '}'
js:spec = (ANY | STR) ('as' (ANY | STR))?
ts:spec = 'type' (ANY | STR) ('as' (ANY | STR))? &(',' | '}' | END) | (ANY | STR) ('as' (ANY | STR))?
export = 'export' ('default' (function | class | assign semi) | '*' ('as' (ANY | STR))? 'from' STR semi | 'type'? named ('from' STR)? semi | variable semi | function | class | extra | '=' expr semi | 'as' 'namespace' NAME semi)
expr = assign (',' assign)*
assign = SIMPLE &STOP | 'yield' ('*' assign | !N assign)? | chain ('?' assign ':' assign)? (BIN assign)?
chain = operand (binary operand)*
js:binary = BIN | '>' '>' '>' '=' | '>' '>' '>' | '>' '>' '=' | '>' '>' | '>'
ts:binary = BIN | '>' '>' '>' '=' | '>' '>' '>' | '>' '>' '=' | '>' '>' | '>'
js:operand = arrow | PRE* postfix
ts:operand = arrow | PRE* postfix (('as' | 'satisfies') ('const' | type))*
js:arrow = 'async'? (NAME | '(' params? ')') '=>' (block | assign)
ts:arrow = 'async'? (NAME | tparams? '(' params? ')' returns?) '=>' (block | assign)
postfix = primary trailer* ('++' | '--')?
js:trailer = '.' (ANY | PRIVATE) | '?.' (ANY | PRIVATE | '[' expr ']' | '(' args? ')') | '[' expr ']' | '(' args? ')' | TPL
ts:trailer = '.' (ANY | PRIVATE) | '?.' (ANY | PRIVATE | '[' expr ']' | '(' args? ')') | '[' expr ']' | '(' args? ')' | TPL | '!' | '<' type (',' type)* '>' &('(' | TPL | ')' | ',' | ';' | '.' | N | block | class_body | END)
args = '...'? assign (',' '...'? assign)* ','?
primary = LIT | function | class | array | object | '(' expr ')' | NAME | PRIVATE | 'new' '.' ANY | 'import' ('(' args ')' | '.' ANY)
array = '[' (','* '...'? assign (',' | &']'))* ','* ']'
object = '{' (entry (',' entry)* ','?)? '}'
entry = '...' assign | (('async' | 'get' | 'set') &(key | '*'))? '*'? key tparams? '(' params? ')' returns? block | key ':' assign | NAME ('=' assign)?
ts:types = type (',' type)*
ts:result = 'asserts'? (NAME | 'this') 'is' type | 'asserts' NAME | type
ts:type = '|'? '&'? union ('extends' union '?' type ':' type)?
ts:union = kind (('|' | '&') kind)*
ts:kind = ('keyof' | 'unique' | 'readonly' | 'infer') kind | 'infer' NAME ('extends' type)? | basic ('[' type? ']')*
ts:basic = 'new'? tparams? '(' params? ')' '=>' result | 'abstract' 'new' tparams? '(' params? ')' '=>' result | '(' type ')' | object_type | '[' (('...'? (NAME '?'? ':')? '...'? type '?'?) (',' ('...'? (NAME '?'? ':')? '...'? type '?'?))* ','?)? ']' | 'typeof' ('import' '(' STR ')' | ANY) ('.' ANY)* targs? | 'import' '(' STR ')' ('.' ANY)* targs? | STR | TPL | '-'? NUM | 'true' | 'false' | 'null' | 'void' | 'this' | NAME ('.' ANY)* targs?
ts:targs = '<' type (',' type)* ','? '>'
ts:object_type = '{' N* (part N*)* '}'
ts:part = (('-' | '+')? 'readonly' &(key | '['))? ('[' NAME 'in' type ('as' type)? ']' (('-' | '+')? '?')? (':' type)? | '[' NAME ':' type ']' ':' type | ('get' | 'set')? key '?'? tparams? '(' params? ')' (':' result)? | 'new'? tparams? '(' params? ')' (':' result)? | key '?'? (':' type)?) (';' | ',' | N | &'}')
"""

JAVA = """
SIMPLE = LIT NAME
STOP = ',' ')' ']' '}' ';'
NAME = ID 'record' 'sealed' 'permits' 'var' 'yield' 'module' 'non' 'with' 'open' 'when'
MOD = 'public' 'private' 'protected' 'static' 'final' 'abstract' 'native' 'synchronized' 'transient' 'volatile' 'strictfp' 'default' 'sealed'
BASIC = 'int' 'long' 'short' 'byte' 'char' 'boolean' 'float' 'double'
BIN = '+' '-' '*' '/' '%' '&' '|' '^' '<<' '<' '<=' '>=' '==' '!=' '&&' '||' '=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<='
PRE = '+' '-' '!' '~' '++' '--'
LIT = NUM STR CHAR 'true' 'false' 'null'
file = (mods 'package' qname ';')? ('import' 'static'? qname ('.' '*')? ';' | ';')* (typedecl | ';')* END
qname = NAME ('.' NAME)*
mods = (annotation | MOD !(block | ':' | '->') | 'non' '-' 'sealed')*
annotation = '@' !'interface' qname ('(' (pairs | avalue)? ')')?
pairs = NAME '=' avalue (',' NAME '=' avalue)*
avalue = avalues | annotation | expr
avalues = '{' (avalue (',' avalue)*)? ','? '}'
typedecl = mods (class | interface | enum | record | '@' 'interface' NAME body)
class = 'class' NAME tparams? ('extends' type)? ('implements' types)? ('permits' types)? body
interface = 'interface' NAME tparams? ('extends' types)? ('permits' types)? body
record = 'record' NAME tparams? '(' params? ')' ('implements' types)? body
enum = 'enum' NAME ('implements' types)? enum_body
enum_body = '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant = annotation* NAME ('(' args? ')')? body?
body = '{' member* '}'
member = ';' | 'static'? block | typedecl | mods (tparams? type NAME '(' params? ')' ('[' ']')* throws? (block | 'default' avalue ';' | ';') | tparams? NAME '(' params? ')' throws? block | NAME block | type declarators ';')
throws = 'throws' types
tparams = '<' annotation* NAME ('extends' type ('&' type)*)? (',' annotation* NAME ('extends' type ('&' type)*)?)* '>'
types = type (',' type)*
type = annotation* (BASIC | 'void' | NAME targs? ('.' annotation* NAME targs?)*) (annotation* '[' ']')*
targs = '<' (targ (',' targ)*)? '>'
targ = annotation* '?' (('extends' | 'super') type)? | type
params = param (',' param)*
param = (annotation | 'final')* type ('...')? (NAME | 'this' | NAME '.' 'this') ('[' ']')*
declarators = NAME ('[' ']')* ('=' init)? (',' NAME ('[' ']')* ('=' init)?)*
init = inits | expr
inits = '{' (init (',' init)*)? ','? '}'
block = '{' statement* '}'
statement = block | ';' | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | for | try | switch ';'? | 'synchronized' '(' expr ')' block | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') NAME? ';' | 'yield' !('=' | '.' | '(' | '++' | '--') expr ';' | 'assert' expr (':' expr)? ';' | NAME ':' statement | local ';' | (annotation | 'final' | 'abstract' | 'static')* (class | interface | enum | record) | expr ';'
local = (annotation | 'final')* type declarators
for = 'for' '(' ((annotation | 'final')* type NAME ':' expr | (local | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?) ')' statement
try = 'try' ('(' resource (';' resource)* ';'? ')' block catch* ('finally' block)? | block (catch+ ('finally' block)? | 'finally' block))
resource = local | expr
catch = 'catch' '(' (annotation | 'final')* type ('|' type)* NAME ')' block
switch = 'switch' '(' expr ')' switch_body
switch_body = '{' (label (':' statement* | '->' (block | 'throw' expr ';' | expr ';')))* '}'
label = 'case' caseitem (',' caseitem)* ('when' expr)? | 'default'
caseitem = 'default' | pattern | ternary
pattern = 'final'? type NAME | type '(' (pattern (',' pattern)*)? ')' NAME? &('->' | ':' | ',' | ')' | 'when')
expr = SIMPLE &STOP | lambda | ternary (BIN expr)?
ternary = chain ('?' expr ':' (lambda | ternary))?
chain = unary (binary (lambda | unary))*
binary = BIN | '>' '>' '>' '=' | '>' '>' '>' | '>' '>' '=' | '>' '>' | '>' | NEVER
lambda = (NAME | '(' (params | NAME (',' NAME)*)? ')') '->' (block | expr)
unary = PRE* (cast (lambda | unary) | postfix ('instanceof' ('final'? pattern | type))?)
cast = '(' BASIC ('[' ']')* ')' | '(' type ('&' type)* ')' &(NAME | LIT | '(' | '!' | '~' | 'this' | 'super' | 'new' | 'switch')
postfix = primary trailer* ('++' | '--')?
trailer = '.' (targs? (NAME | 'super' | 'this') | 'class' | 'new' targs? NAME targs? '(' args? ')' body?) | '[' expr ']' | '(' args? ')' | '::' targs? (NAME | 'new')
args = expr (',' expr)*
primary = LIT | 'this' | 'super' | '(' expr ')' | 'new' creation | switch | (BASIC | 'void') ('[' ']')* ('.' 'class' | '::' 'new') | NAME targs? ('[' ']')+ ('.' 'class' | '::' 'new') | NAME targs ('.' NAME targs?)* &'::' | NAME
creation = targs? annotation* (BASIC | NAME targs? ('.' NAME targs?)*) (('[' ']')+ inits | ('[' expr ']')+ ('[' ']')* | '(' args? ')' body?)
"""

HCL = """
BIN = '+' '-' '*' '/' '%' '==' '!=' '<' '>' '<=' '>=' '&&' '||'
file = N* (item (N N* | END))* END
item = ID '=' expr | ID (STR | ID)* body
body = '{' N* (item N N*)* item? '}'
expr = unary (BIN N* unary)* (N* '?' N* expr N* ':' N* expr)?
unary = ('-' | '!')* primary
primary = atom ('.' (ID | NUM | '*') | '[' N* ('*' | expr) N* ']')*
atom = NUM | STR | HEREDOC | ID ('::' ID)* ('(' N* (expr N* (',' N* expr N*)* (',' | '...')? N*)? ')')? | '(' N* expr N* ')' | '[' N* (forexpr | expr N* (',' N* expr N*)* ','?)? N* ']' | object
object = '{' N* (forexpr | pair ((',' N* | N N*) pair)* ','?)? N* '}'
pair = (ID !('.' | '(' | '[') | STR | '(' expr ')' | expr) ('=' | ':') N* expr
forexpr = 'for' ID (',' ID)? 'in' N* expr N* ':' N* expr N* ('=>' N* expr '...'?)? N* ('if' N* expr N*)?
"""

BASH = """
WORDS = WORD ASSIGN NUMBER 'in' '{' '}' '!' 'function' 'select' 'time' 'coproc' 'if' 'then' 'elif' 'else' 'fi' 'for' 'while' 'until' 'do' 'done' 'case' 'esac' '[[' ']]'
PLAIN = WORD ASSIGN NUMBER 'in'
REDIR = '<' '>' '>>' '<<' '<<<' '>&' '<&' '&>' '&>>' '<>' '>|' '<<-'
file = nl list? END
nl = N*
list = andor ((';' | '&' | N) nl andor)* (';' | '&' | N)? nl
andor = pipeline (('&&' | '||') nl pipeline)*
pipeline = ('!' | 'time')* command (('|' | '|&') nl command)*
command = funcdef | compound redirect* | simple
simple = (ASSIGN array? | redirect)+ (head tail*)? | head tail*
head = (PLAIN | '!' | ']]' ) !funcparen
funcparen = '(' ')'
tail = ASSIGN array | WORDS | redirect
array = '(' (N | WORDS)* ')'
redirect = NUMBER? REDIR WORDS
funcdef = 'function' (PLAIN) ('(' ')')? nl compound redirect* | PLAIN '(' ')' nl compound redirect*
compound = '{' nl list '}' | '(' nl list ')' | ARITH | cond | 'if' nl list 'then' nl list ('elif' nl list 'then' nl list)* ('else' nl list)? 'fi' | ('while' | 'until') nl list 'do' nl list 'done' | ('for' | 'select') (ARITH (';' | N)? nl ('do' nl list 'done' | '{' nl list '}') | PLAIN nl ('in' WORDS* (';' | N))? ';'? nl ('do' nl list 'done' | '{' nl list '}')) | 'case' WORDS nl 'in' nl caseitem* 'esac' | 'coproc' command
caseitem = '('? !'esac' WORDS ('|' WORDS)* ')' nl list? (';;' | ';&' | ';;&' | &'esac') nl
cond = '[[' condexpr ']]'
condexpr = nl condunit (nl ('&&' | '||') nl condunit)* nl
condunit = '!' condunit | (WORDS_IN | CONDPART)+
WORDS_IN = WORD ASSIGN NUMBER 'in' '{' '}' '!' 'if' 'then' 'else' 'for' 'do' 'done' 'case' 'function'
CONDPART = '<' '>' '(' ')' '|'
"""
YAML = """
file = start* (block start+)* block? END
start = DIRECTIVE+ DOC | DOC | ENDDOC
block = mapping | sequence | single
prop = ANCHOR | TAG
mapping = pair+
pair = prop* key COLON value
key = PLAIN | DQ | SQ | ALIAS | flow
value = prop* SEP (IND block DED | &DASH sequence)? | prop* scalar SEP more?
scalar = PLAIN | DQ | SQ | BLOCK | ALIAS | flow
more = IND (PLAIN SEP)+ DED
sequence = (DASH item)+
item = SEP (IND block DED)? | IND block DED
single = prop* (SEP mapping | PLAIN SEP (PLAIN SEP)* more? !COLON | (DQ | SQ | BLOCK | ALIAS | flow) SEP)
flow = '[' (flowitem (',' flowitem)* ','?)? ']' | '{' (flowitem (',' flowitem)* ','?)? '}'
flowitem = prop* fnode (COLON (prop* fnode)?)? | COLON (prop* fnode)?
fnode = (PLAIN)+ | DQ | SQ | ALIAS | flow
"""
