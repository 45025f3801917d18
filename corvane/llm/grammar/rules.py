"""Grammars of the supported languages. Operators are read flat, as precedence doesn't matter to
whether a text is valid; what needs names or types to be resolved is accepted."""

import re

PYTHON = """
Unit = Stmts
Stmts = Stmt*
Stmt = Line | Compound
Line = Small % ';' ';'? 'nl'
Small = Assign | 'pass' | 'break' | 'continue' | 'return' Tests? | 'raise' (Test ('from' Test)?)? | 'global' 'id' % ',' | 'nonlocal' 'id' % ','
  | 'del' Targets | 'assert' Test (',' Test)? | 'import' Dotted % ',' | 'from' Origin 'import' ('*' | Names | (| Names ','? |)) | 'type' 'id' TypeParams? '=' Test
Dotted = Name ('.' Name)* ('as' Name)?
Origin = ('.' | '...')* Name ('.' Name)* | ('.' | '...')+
Names = (Name ('as' Name)?) % ','
Name = 'id' | 'match' | 'case' | 'type'
Assign = Stars | (Targets '=')+ Value | Place AugOp Value | (Place | (| Place |)) ':' Test ('=' Value)?
Targets = Target % ',' ','?
Target = '*'? (Place | (| Targets? |) | [| Targets? |])
Place = Name | Atom Trailer* ('.' Name | [| Subs |]) | (| Place |)
Value = 'yield' ('from' Test | Stars)? | Stars
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Stars = (Test | '*' Test) % ',' ','?  | 'yield' ('from' Test | Stars)?
Tests = Stars
Test = Or ('if' Or 'else' Test)? | 'lambda' LambdaArgs? ':' Test | Name ':=' Test
Or = NotTest (('and' | 'or') NotTest)*
NotTest = 'not'* Compare
Compare = Arith (CompOp Arith)*
CompOp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
Arith = Factor (('|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' | '//' | '@' | '**') Factor)*
Factor = ('+' | '-' | '~')* 'await'? Atom Trailer*
Atom = Name | 'num' | 'str'+ | '...' | 'None' | 'True' | 'False' | (| (Stars | Comp)? |) | [| (Stars | Comp)? |] | {| DictOrSet? |}
Comp = (Test | '*' Test) CompFor
CompFor = ('async'? 'for' Targets 'in' Or ('if' CondTest)*)+
CondTest = Or | 'lambda' LambdaArgs? ':' CondTest | Name ':=' Test
DictOrSet = (Test ':' Test | '**' Test) % ',' ','? | Test ':' Test CompFor | Stars | Comp
Trailer = (| Args? |) | [| Subs |] | '.' Name
Args = Given (',' Named)? (',' Spread)? ','? | Named (',' Spread)? ','? | Spread ','? | Test CompFor
Given = (Test | '*' Test) % ','
Named = (Name '=' Test | '*' Test) % ','
Spread = (Name '=' Test | '**' Test) % ','
Subs = Sub % ',' ','?
Sub = Test | '*' Test | Test? ':' Test? (':' Test?)?
Params = Bare % ',' (',' '/' (',' Bare % ',')?)? (',' Filled % ',')? (',' Rest)? ','? | Bare % ',' ',' Filled % ',' ',' '/' (',' Filled % ',')? (',' Rest)? ','?
  | Filled % ',' (',' '/' (',' Filled % ',')?)? (',' Rest)? ','? | Rest ','?
Bare = Name (':' Test)?
Filled = Name (':' Test)? '=' Test
Rest = '*' Name (':' ('*' Test | Test))? (',' (Bare | Filled) % ',')? (',' Tail)? | '*' ',' (Bare | Filled) % ',' (',' Tail)? | Tail
Tail = '**' Name (':' Test)?
LambdaArgs = Name % ',' (',' '/' (',' Name % ',')?)? (',' LambdaFilled % ',')? (',' LambdaRest)? ','? | Name % ',' ',' LambdaFilled % ',' ',' '/' (',' LambdaFilled % ',')? (',' LambdaRest)? ','?
  | LambdaFilled % ',' (',' '/' (',' LambdaFilled % ',')?)? (',' LambdaRest)? ','? | LambdaRest ','?
LambdaFilled = Name '=' Test
LambdaRest = '*' Name (',' (Name | LambdaFilled) % ',')? (',' '**' Name)? | '*' ',' (Name | LambdaFilled) % ',' (',' '**' Name)? | '**' Name
Compound = 'if' Test ':' Suite ('elif' Test ':' Suite)* Else? | 'while' Test ':' Suite Else? | 'async'? 'for' Targets 'in' Stars ':' Suite Else?
  | 'try' ':' Suite (Except+ Else? Finally? | Finally) | 'async'? 'with' WithItems ':' Suite | Decorator* 'async'? Def | Decorator* Class | Match
Else = 'else' ':' Suite
Finally = 'finally' ':' Suite
Except = 'except' ':' Suite | 'except' '*'? Test ('as' Name)? ':' Suite
WithItems = WithItem % ',' | (| WithItem % ',' ','? |)
WithItem = Test ('as' Target)?
Decorator = '@' Test 'nl'
Def = 'def' Name TypeParams? (| Params? |) ('->' Test)? ':' Suite
Class = 'class' Name TypeParams? (| Args? |)? ':' Suite
Class = 'class' Name TypeParams? ':' Suite
TypeParams = [| (('*' | '**')? Name (':' Test)? ('=' Test)?) % ',' ','? |]
Suite = Line | 'nl' <| Stmts |>
Match = 'match' Stars ':' 'nl' <| Case+ |>
Case = 'case' Patterns ('if' Test)? ':' Suite
Patterns = PatAs % ',' ','?
PatAs = '*' Name | Pat ('|' Pat)* ('as' Name)?
Pat = '-'? 'num' (('+' | '-') 'num')? | 'str'+ | 'None' | 'True' | 'False' | Name ('.' Name)* (| PatArgs? |)? | Name ('.' Name)* | (| Patterns? |) | [| Patterns? |] | {| PatMap? |}
PatArgs = ((Name '=')? PatAs) % ',' ','?
PatMap = (PatKey ':' PatAs | '**' Name) % ',' ','?
PatKey = '-'? 'num' | 'str'+ | 'None' | 'True' | 'False' | Name ('.' Name)+
"""
PYTHON = PYTHON.replace("Class = 'class' Name TypeParams? (| Args? |)? ':' Suite\nClass", "Class = 'class' Name TypeParams? (| Args? |) ':' Suite\nClass").replace("Name ('.' Name)* (| PatArgs? |)? |", "Name ('.' Name)* (| PatArgs? |) |")

GO = """
Unit = 'package' 'id' ';' ('import' (ImportSpec | (| Imports |)) ';')* Top*
Top = Decl ';' | Func ';' | ';'
Imports = (ImportSpec ';')* ImportSpec?
ImportSpec = ('id' | '.')? 'str'
Decl = 'const' (ConstSpec | (| (ConstSpec ';')* ConstSpec? |)) | 'var' (VarSpec | (| (VarSpec ';')* VarSpec? |)) | 'type' (TypeSpec | (| (TypeSpec ';')* TypeSpec? |))
ConstSpec = 'id' % ',' (Type? '=' Exprs)?
VarSpec = 'id' % ',' (Type ('=' Exprs)? | '=' Exprs)
TypeSpec = 'id' TypeParams? '='? Type
TypeParams = [| ('id' % ',' Constraint) % ',' ','? |]
Constraint = ('~'? Type) % '|'
Func = 'func' (| Params? |) 'id' Sig Body? | 'func' 'id' TypeParams? Sig Body?
Sig = (| Params? |) ((| Params? |) | Type)?
Params = Param % ',' ','?
Param = ('id')? '...'? Type
Body = {| Stmts |}
Type = 'id' ('.' 'id')? TypeArgs? | '*' Type | [| ('...' | Expr)? |] Type | 'map' [| Type |] Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig
  | 'struct' {| (Field ';')* Field? |} | 'interface' {| (Method ';')* Method? |} | (| Type |)
TypeArgs = [| Type % ',' ','? |]
Field = ('id' % ',' Type | '*'? 'id' ('.' 'id')? TypeArgs?) 'str'?
Method = 'id' Sig | Constraint
Stmts = Stmt*
Stmt = Simple? End | Decl End | Body End | 'go' Expr End | 'defer' Expr End | 'return' Exprs? End | 'break' 'id'? End | 'continue' 'id'? End | 'goto' 'id' End | 'fallthrough' End
  | If End | For End | Switch End | 'select' {| Comm* |} End | 'id' ':' Stmt | 'id' ':' $
End = ';' | $
Simple = Exprs ((('=' | ':=') Exprs) | AssignOp Expr | '++' | '--' | '<-' Expr)?
AssignOp = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
If = 'if' (Simple? ';')? Expr Body ('else' (If | Body))?
For = 'for' (Simple? ';' Expr? ';' Simple? | Expr | (Exprs ('=' | ':='))? 'range' Expr)? Body
Switch = 'switch' (Simple? ';')? Simple? {| Case* |}
Case = ('case' (Expr | Type) % ',' | 'default') ':' Stmts
Comm = ('case' Simple | 'default') ':' Stmts
Exprs = Expr % ','
Expr = Unary (BinOp Unary)*
BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* Primary
Primary = Operand Post*
Operand = 'id' | 'num' | 'str' | 'func' Sig Body | (| Expr |) | (| Type |) | CompType Literal | CompType (| Args |)
CompType = [| ('...' | Expr)? |] Type | 'map' [| Type |] Type | 'struct' {| (Field ';')* Field? |} | 'chan' '<-'? Type | 'interface' {| (Method ';')* Method? |} | 'func' Sig
Post = '.' 'id' | '.' (| ('type' | Type) |) | [| Expr % ',' ','? |] | [| Expr? ':' Expr? (':' Expr)? |] | [| Type % ',' |] | (| Args? |) | Literal
Args = (Expr | Type) % ',' '...'? ','?
Literal = {| (Element % ',' ','?)? |}
Element = (ElementValue ':')? ElementValue
ElementValue = Expr | Literal
"""

JAVA = """
Unit = Ordinary | Modular
Ordinary = (Annot* 'package' QName ';')? ';'* Import* (TypeDecl | ';')*
Modular = Import* Annot* 'open'? 'module' QName {| @any* |}
Import = 'import' 'static'? QName ('.' '*')? ';' | ';'
QName = Id ('.' Id)*
Id = 'id' | 'record' | 'sealed' | 'permits' | 'yield' | 'var' | 'open' | 'module'
Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | Annot
Annot = '@' QName | '@' QName (| AnnArgs? |)
AnnArgs = ElemValue | (Id '=' ElemValue) % ','
ElemValue = Expr | Annot | {| (ElemValue % ',' ','?)? |}
TypeDecl = Mod* ('class' Id TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? {| Members |}
  | 'interface' Id TypeParams? ('extends' Types)? ('permits' Types)? {| Members |} | '@' 'interface' Id {| Members |}
  | 'enum' Id ('implements' Types)? {| EnumBody |} | 'record' Id TypeParams? (| Params? |) ('implements' Types)? {| Members |})
EnumBody = (Constant % ',')? ','? (';' Members)?
Constant = Annot* Id (| Args? |) {| Members |} | Annot* Id (| Args? |) | Annot* Id {| Members |} | Annot* Id
Members = Member*
Member = ';' | 'static'? Block | TypeDecl | Mod* TypeParams? Id Block | Mod* TypeParams? Annot* Type? Id (| Params? |) Dims? ('throws' Types)? (Block | ';' | 'default' ElemValue ';') | Mod* Type Declarators ';'
TypeParams = '<' (Annot* Id ('extends' Type ('&' Type)*)?) % ',' '>'
Types = Type % ','
Type = Annot* (Prim | Id TypeArgs? ('.' Annot* Id TypeArgs?)*) Dims?
Prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void'
Dims = (Annot* [| |])+
TypeArgs = '<' (TypeArg % ',')? '>'
TypeArg = Type | Annot* '?' (('extends' | 'super') Type)?
Params = Param % ','
Param = ParamMod* Type '...'? (Id Dims? | Id '.' 'this' | 'this')
ParamMod = 'final' | Annot
Declarators = (Id Dims? ('=' (Expr | ArrayInit))?) % ','
ArrayInit = {| ((Expr | ArrayInit) % ',' ','?)? |}
Block = {| Stmts |}
Stmts = Stmt*
Stmt = ';' | Block | ParamMod* Type Declarators ';' | TypeDecl | StmtExpr ';' | 'if' (| Expr |) Stmt ('else' Stmt)? | 'while' (| Expr |) Stmt | 'do' Stmt 'while' (| Expr |) ';'
  | 'for' (| ForHead |) Stmt | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';' | 'assert' Expr (':' Expr)? ';'
  | 'synchronized' (| Expr |) Block | Try | 'switch' (| Expr |) {| SwitchBody |} | Id ':' Stmt
ForHead = ForInit? ';' Expr? ';' (StmtExpr % ',')? | ParamMod* Type Id ':' Expr
ForInit = ParamMod* Type Declarators | StmtExpr % ','
StmtExpr = Place AssignOp Expr | ('++' | '--') Primary | Operand Post* ('++' | '--' | (| Args? |) | '.' New) | New
Try = 'try' Block (Catch+ Finally? | Finally) | 'try' (| Resource % ';' ';'? |) Block Catch* Finally?
Resource = ParamMod* Type Id '=' Expr | Expr
Catch = 'catch' (| ParamMod* Type ('|' Type)* Id |) Block
Finally = 'finally' Block
SwitchBody = (Label ':' Stmt*)* | (Label '->' (Expr ';' | Block | 'throw' Expr ';'))*
Label = 'case' Pattern % ',' ('when' Expr)? | 'default'
Pattern = Expr | 'default' | ParamMod* Type Id | Type (| (Pattern % ',')? |) Id?
Expr = Ternary | Place AssignOp Expr | Lambda
Place = Id | Operand Post* ('.' Id | [| Expr |]) | (| Place |)
Lambda = (Id | (| (Id % ',')? |) | (| Params |)) '->' (Expr | Block)
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
Ternary = Binary ('?' Expr ':' (Ternary | Lambda))?
Binary = Unary (BinOp Unary | 'instanceof' 'final'? (Type Id? | Type (| (Pattern % ',')? |) Id?))*
BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
Unary = ('+' | '-' | '!' | '~' | '++' | '--' | (| Type ('&' Type)* |))* (Primary | Lambda)
Primary = Operand Post*
Operand = 'num' | 'str' | 'true' | 'false' | 'null' | 'this' | 'super' | Id | (| Expr |) | New | (Prim Dims? | Id TypeArgs? ('.' Id TypeArgs?)* Dims?) '::' (Id | 'new') | Prim Dims? '.' 'class' | QName Dims '.' 'class'
  | 'switch' (| Expr |) {| SwitchBody |}
New = 'new' TypeArgs? Annot* (Prim | Id TypeArgs? ('.' Id TypeArgs?)*) ((| Args? |) | (| Args? |) {| Members |} | [| Expr |]+ Dims? | Dims ArrayInit)
Post = '.' (TypeArgs? (Id | 'super' | 'this' | 'class') | New) | [| Expr |] | (| Args? |) | '++' | '--' | '::' TypeArgs? (Id | 'new')
Args = Expr % ','
"""

RUST = """
Unit = Tops
Tops = Item*
Item = Attr* Vis? ItemKind | InnerAttr | Attr* MacroItem | ';'
InnerAttr = '#' '!' [| @any* |]
Attr = '#' [| @any* |]
Vis = 'pub' | 'pub' (| 'in'? Path |) | 'pub' (| ('crate' | 'self' | 'super') |) | 'crate'
ItemKind = 'use' UseTree ';' | 'mod' 'id' (';' | {| Tops |}) | 'extern' 'crate' ('id' | 'self') ('as' 'id')? ';' | FnQual* 'fn' 'id' Generics? (| FnParams? |) ('->' Type)? Where? (Block | ';')
  | 'struct' 'id' Generics? (Where? {| Fields |} | (| TupleFields |) Where? ';' | Where? ';') | 'union' 'id' Generics? {| Fields |} | 'enum' 'id' Generics? Where? {| (Variant % ',' ','?)? |}
  | 'unsafe'? 'impl' Generics? 'const'? ('!'? Type 'for')? Type Where? {| Assocs |} | 'unsafe'? 'auto'? 'trait' 'id' Generics? (':' Bounds?)? Where? {| Assocs |}
  | 'type' 'id' Generics? (':' Bounds)? Where? ('=' Type)? Where? ';' | 'const' ('id' | '_') (':' Type)? ('=' Expr)? ';' | 'static' 'mut'? 'id' ':' Type ('=' Expr)? ';' | 'unsafe'? 'extern' 'str'? {| Assocs |}
MacroItem = Path '!' 'id'? ({| @any* |} | (| @any* |) ';' | [| @any* |] ';')
UseTree = ('::'? UseSeg '::')* ('*' | {| (UseTree % ',' ','?)? |} | UseSeg ('as' ('id' | '_'))?)
UseSeg = 'id' | 'self' | 'super' | 'crate'
FnQual = 'const' | 'async' | 'unsafe' | 'extern' 'str'? | 'default'
FnParams = FnParam % ',' ','?
FnParam = Attr* ('&' 'life'? 'mut'? 'self' | 'mut'? 'self' (':' Type)? | Pat ':' Type | '...' | Type)
Generics = '<' ((Attr* ('life' (':' LifeBounds?)? | 'id' (':' Bounds?)? ('=' Type)? | 'const' 'id' ':' Type ('=' GenericArg)?)) % ',' ','?)? '>'
LifeBounds = 'life' % '+'
Where = 'where' ((('for' Generics)? Type ':' Bounds? | 'life' ':' LifeBounds) % ',' ','?)?
Bounds = Bound % '+'
Bound = 'life' | '?'? ('for' Generics)? Path | (| '?'? ('for' Generics)? Path |) | '~' 'const' Path
Fields = ((Attr* Vis? 'id' ':' Type) % ',' ','?)?
TupleFields = ((Attr* Vis? Type) % ',' ','?)?
Variant = Attr* Vis? 'id' ({| Fields |} | (| TupleFields |))? ('=' Expr)?
Assocs = Assoc*
Assoc = Attr* Vis? AssocKind | Attr* MacroItem | InnerAttr
AssocKind = FnQual* 'fn' 'id' Generics? (| FnParams? |) ('->' Type)? Where? (Block | ';') | 'default'? 'type' 'id' Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';' | 'const' ('id' | '_') ':' Type ('=' Expr)? ';' | 'static' 'mut'? 'id' ':' Type ';'
Type = Path | '&' 'life'? 'mut'? Type | '&&' 'life'? 'mut'? Type | '*' ('const' | 'mut') Type | (| (Type % ',' ','?)? |) | [| Type (';' Expr)? |] | '!' | '_' | ('for' Generics)? ('unsafe')? ('extern' 'str'?)? 'fn' (| ((('id' | '_') ':')? Type | '...') % ',' ','? |) ('->' Type)?
  | ('for' Generics)? 'unsafe'? ('extern' 'str'?)? 'fn' (| |) ('->' Type)? | 'dyn' Bounds | 'impl' Bounds | Path '!' ((| @any* |) | [| @any* |] | {| @any* |}) | '<' Type ('as' Path)? '>' ('::' PathSeg)+ | (| Bounds |)
Path = '::'? PathSeg ('::' PathSeg)*
PathSeg = ('id' | 'self' | 'super' | 'crate' | 'Self' | 'union' | 'auto' | 'default') ('::'? '<' (GenericArg % ',' ','?)? '>' | (| (Type % ',' ','?)? |) '->' Type)? | 'id' (| (Type % ',' ','?)? |)
GenericArg = 'life' | Type | 'id' Generics? (':' Bounds | '=' Type) | '-'? 'num' | 'str' | 'true' | 'false' | Block
Block = {| Stmts |}
Stmts = Stmt*
Stmt = ';' | Attr* Vis? ItemKind | InnerAttr | Attr* 'let' Pat (':' Type)? ('=' Expr ('else' Block)?)? ';' | Attr* BlockLike | Attr* Expr (';' | $) | Attr* Path '!' {| @any* |}
BlockLike = 'life'? ':'? ('unsafe' | 'async' 'move'? | 'const')? Block | 'life'? ':'? ('loop' Block | 'while' Cond Block | 'for' Pat 'in' Expr Block) | If | 'match' Expr {| InnerAttr* Arms |}
BlockLike = 'life' ':' BlockLike
If = 'if' Cond Block ('else' (If | Block))?
Cond = Expr
Arms = (Arm* LastArm)?
Arm = Attr* Pat ('if' Expr)? '=>' (Expr ',' | BlockLike ','?)
LastArm = Attr* Pat ('if' Expr)? '=>' Expr ','? | Arm
Pat = '|'? PatOne % '|'
PatOne = '_' | '..' | ('ref')? 'mut'? 'id' ('@' PatOne)? | Path | Path (| (Pat % ',' ','?)? |) | Path {| (PatField % ',' ','?)? |} | (| (Pat % ',' ','?)? |) | [| (Pat % ',' ','?)? |] | '&' 'mut'? PatOne | '&&' 'mut'? PatOne | Lit | PatEnd? ('..=' | '..' | '...') PatEnd? | Path '!' ((| @any* |) | [| @any* |]) | 'box' PatOne
PatEnd = Lit | Path
PatField = Attr* ('..' | ('id' | 'num') ':' Pat | 'ref'? 'mut'? 'id')
Lit = '-'? 'num' | 'str' | 'true' | 'false'
Expr = Unary (BinOp Unary | '..' Unary | '..=' Unary | 'as' Type)* '..'?
BinOp = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>='
Unary = ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut'))* Primary | '..' Unary? | '..=' Unary | 'let' Pat '=' Unary
Primary = Operand Post*
Operand = Lit | Path | Path {| (StructField % ',' ','?)? |} | '<' Type ('as' Path)? '>' ('::' PathSeg)+ | Path '!' ((| @any* |) | [| @any* |] | {| @any* |}) | (| (Expr % ',' ','?)? |) | [| (Expr % ',' ','? | Expr ';' Expr)? |] | BlockLike
  | ('static' | 'async')? 'move'? ('||' | '|' (ClosureParam % ',' ','?)? '|') (Expr | '->' Type Block) | 'return' Expr? | 'break' 'life'? Expr? | 'continue' 'life'? | 'life' ':' BlockLike | '_' | 'yield' Expr?
ClosureParam = PatOne (':' Type)?
StructField = Attr* (('id' | 'num') (':' Expr)? | '..' Expr?)
Post = '.' ('id' | 'num' | 'await') ('::' '<' (GenericArg % ',' ','?)? '>')? | (| (Expr % ',' ','?)? |) | [| Expr |] | '?'
"""
RUST = RUST.replace("BlockLike = 'life'? ':'? ('unsafe' | 'async' 'move'? | 'const')? Block | 'life'? ':'? ('loop'", "BlockLike = ('unsafe' | 'async' 'move'? | 'const')? Block | ('loop'")

CPP = """
Unit = Tops
Tops = Decl*
Decl = ';' | 'namespace' Attrs? Name? {| Tops |} | 'inline' 'namespace' Name {| Tops |} | 'namespace' 'id' '=' Name ';' | 'using' 'namespace' Name ';' | 'using' 'typename'? Name % ',' ';' | 'using' 'id' Attrs? '=' TypeId ';' | 'using' 'enum' Name ';'
  | 'template' '<' (TParam % ',')? '>' Requires? Decl | 'template' Decl | 'extern' 'str' ({| Tops |} | Decl) | 'static_assert' (| Args |) ';' | 'asm' (| @any* |) ';' | Attrs* Specs InitDecls? ';' | Attrs* Specs FuncDecl FuncBody | Attrs* Spec* FuncDecl (FuncBody | ';') | 'concept' 'id' '=' Expr ';' | 'friend' Decl
  | 'typedef' Specs InitDecls ';' | 'id' (| @any* |) ';'?
Requires = 'requires' Expr
TParam = ('typename' | 'class') '...'? 'id'? ('=' TypeId)? | 'template' '<' (TParam % ',')? '>' ('class' | 'typename') '...'? 'id'? ('=' Name)? | Specs Declarator? ('=' Unary)? | Name '...'? 'id' ('=' TypeId)?
Attrs = [| [| @any* |] |] | 'alignas' (| @any* |) | '__attribute__' (| @any* |)
Specs = Spec* TypeCore Spec*
Spec = 'const' | 'volatile' | 'static' | 'extern' | 'inline' | 'constexpr' | 'consteval' | 'constinit' | 'virtual' | 'explicit' | 'explicit' (| Expr |) | 'mutable' | 'register' | 'thread_local' | 'friend' | 'typedef' | Attrs | 'restrict'
TypeCore = Prim+ | 'auto' | 'decltype' (| Expr |) | 'typename' Name | Name | ('struct' | 'class' | 'union') Attrs? Name? 'final'? (':' Base % ',')? {| Members |} | ('struct' | 'class' | 'union' | 'enum') Name | 'enum' ('class' | 'struct')? Name? (':' TypeId)? {| (Enumerator % ',' ','?)? |} | 'enum' ('class' | 'struct') Name (':' TypeId)?
Prim = 'int' | 'long' | 'short' | 'char' | 'bool' | 'float' | 'double' | 'void' | 'signed' | 'unsigned' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t'
Enumerator = 'id' Attrs? ('=' Expr)?
Base = ('public' | 'private' | 'protected' | 'virtual')* Name '...'?
Members = Member*
Member = ('public' | 'private' | 'protected') ':' | Decl | Attrs* Specs? BitFields ';'
BitFields = (Declarator? ':' Expr ('=' Expr)?) % ','
Name = '::'? Seg ('::' Seg)*
Seg = 'template'? 'id' TArgs? | '~' 'id' | 'operator' Op | 'operator' Specs Ptr*
Op = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '>' '>' | '<<=' | '>' '>=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | (| |) | [| |] | 'new' ([| |])? | 'delete' ([| |])? | 'str' 'id'?
TArgs = '<' ((TypeId '...'? | Unary (BinNoGt Unary)*) % ',')? '>'
TypeId = Specs Ptr* AbsSuffix*
AbsSuffix = (| Params? |) Quals | [| Expr? |] | (| Ptr+ 'id'? |) | (| Ptr+ |) (| Params? |)
Ptr = '*' | '&' | '&&' | 'const' | 'volatile' | '...' | Name '::' '*' | 'restrict'
InitDecls = InitDecl % ','
InitDecl = Declarator Attrs* (Init)?
Init = '=' InitValue | BraceInit | (| Args |) | '=' 'default' | '=' 'delete' | ':' Expr
InitValue = Expr | BraceInit
BraceInit = {| (((('.' 'id')+ '='?)? InitValue '...'?) % ',' ','?)? |}
Declarator = Ptr* (Name | [| 'id' % ',' |] | (| Declarator |)) Attrs* Suffix*
Suffix = (| Params? |) Quals | [| Expr? |]
Quals = ('const' | 'volatile' | '&' | '&&' | 'noexcept' | 'noexcept' (| Expr |) | 'override' | 'final' | 'throw' (| @any* |) | '->' TypeId | Attrs | Requires)*
FuncDecl = Ptr* Name (| Params? |) Quals | Ptr* (| Declarator |) (| Params? |) Quals
FuncBody = (':' MemInit % ',')? Block | 'try' (':' MemInit % ',')? Block Catch+ | '=' ('default' | 'delete') ';'
MemInit = Name ((| Args? |) | BraceInit) '...'?
Params = Param % ',' | (Param % ',' ','?)? '...'
Param = Attrs* 'this'? Specs (Declarator | Ptr* AbsSuffix*) ('=' InitValue)? | Attrs* Specs Ptr+ Name? ('=' InitValue)?
Block = {| Stmts |}
Stmts = Stmt*
Stmt = Decl | Block | Exprs ';' | 'if' 'constexpr'? (| Cond |) Stmt ('else' Stmt)? | 'while' (| Cond |) Stmt | 'do' Stmt 'while' (| Exprs |) ';' | 'for' (| ForHead |) Stmt | 'switch' (| Cond |) Stmt | 'case' Expr ('...' Expr)? ':' | 'default' ':' | 'id' ':'
  | 'return' (Exprs | BraceInit)? ';' | 'break' ';' | 'continue' ';' | 'goto' 'id' ';' | 'try' Block Catch+ | 'co_return' Exprs? ';' | Attrs Stmt
Catch = 'catch' (| (Param | '...') |) Block
Cond = (Init2 ';')? (Exprs | Specs Declarator Init)
Init2 = Exprs | Specs InitDecls
ForHead = Init2? ';' (Exprs | Specs Declarator Init)? ';' Exprs? | (Init2 ';')? Attrs* Specs Declarator ':' InitValue
Exprs = Expr % ','
Expr = Tern (AssignOp InitValue)? | 'throw' Expr? | 'co_await' Expr | 'co_yield' InitValue
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>='
Tern = Bin ('?' Exprs ':' Expr)?
Bin = Unary (BinOp Unary)*
BinNoGt = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '<=' | '>=' | '<=>' | '<<' | '+' | '-' | '*' | '/' | '%' | '.*' | '->*'
BinOp = BinNoGt | '>' | '>' '>' | 'and' | 'or' | 'xor' | 'bitand' | 'bitor'
Unary = ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | 'not' | 'compl' | (| TypeId |))* Primary | 'sizeof' '...'? (| @any* |) | 'sizeof' Unary | 'alignof' (| TypeId |) | 'noexcept' (| Expr |) | 'co_await' Unary
Primary = Operand Post*
Operand = 'num' | 'str'+ | 'true' | 'false' | 'nullptr' | 'this' | Name | Name BraceInit | (| Exprs |) | (| (Exprs ',')? '...' BinOp Expr |) | (| Expr BinOp '...' (BinOp Expr)? |) | Prim+ ((| Args? |) | BraceInit) | 'auto' ((| Args |) | BraceInit) | 'typename' Name ((| Args? |) | BraceInit) | Lambda
  | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' TypeId '>' (| Exprs |) | 'typeid' (| @any* |) | '::'? 'new' (| Args |)? NewType | '::'? 'new' NewType | '::'? 'delete' [| |] Unary | '::'? 'delete' Unary | 'requires' (| Params? |) {| @any* |} | 'requires' {| @any* |} | 'decltype' (| Expr |) ('::' Seg)* ((| Args? |) | BraceInit)? | BraceInit
NewType = (Specs Ptr* | (| TypeId |)) [| Expr? |]* ((| Args? |) | BraceInit)?
Lambda = [| Captures? |] ('<' (TParam % ',')? '>')? ((| Params? |) LambdaQuals)? Block | [| Captures? |] LambdaQuals Block
LambdaQuals = ('mutable' | 'constexpr' | 'static' | 'noexcept' | 'noexcept' (| Expr |) | '->' TypeId | Attrs | Requires)*
Captures = ('&' | '=' | ('&' | '*')? ('this' | 'id') '...'? | '&'? '...'? 'id' '=' InitValue | '&'? 'id' BraceInit) % ','
Post = ('.' | '->') ('template')? (Name | '~' 'id') | (| Args? |) | [| Args? |] | '++' | '--' | '...'
Args = (InitValue '...'?) % ','
"""
CPP = CPP.replace("| '::'? 'new' (| Args |)? NewType |", "| '::'? 'new' (| Args |) NewType |").replace("[| Expr? |]* ((| Args? |)", "([| Expr? |])* ((| Args? |)")

#: C beside C++: words that are only C++'s are names, and so on. Every symbol begins with C.
C = """
CUnit = (CDecl | CFunction | ';')*
CId = 'id' | 'alignas' | 'alignof' | 'and' | 'asm' | 'bool' | 'catch' | 'char8_t' | 'class' | 'compl' | 'concept' | 'consteval' | 'constinit' | 'const_cast' | 'co_await' | 'co_return' | 'co_yield' | 'decltype' | 'delete' | 'dynamic_cast' | 'explicit' | 'export' | 'final' | 'friend' | 'mutable' | 'namespace' | 'new' | 'noexcept' | 'not' | 'operator' | 'or' | 'override' | 'private' | 'protected' | 'public' | 'reinterpret_cast' | 'requires' | 'static_cast' | 'template' | 'this' | 'throw' | 'try' | 'typeid' | 'typename' | 'using' | 'virtual' | 'wchar_t' | 'xor' | 'bitand' | 'bitor'
CAttr = '__attribute__' (| @any* |) | [| [| @any* |] |] | 'alignas' (| @any* |)
CSpec = 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | 'thread_local' | 'const' | 'volatile' | 'restrict' | 'constexpr' | CAttr
CType = CSpec* CCore (CSpec | CPrim)*
CPrim = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool'
CCore = CPrim+ | CId | ('struct' | 'union') CAttr* (CId? {| CField* |} | CId) | 'enum' CAttr* (CId? {| ((CId ('=' CCond)?) % ',' ','?)? |} | CId) | 'typeof' (| @any* |)
CField = CType ((CDeclarator (':' CCond)? | ':' CCond) % ',')? CAttr* ';' | 'static_assert' (| CArgs |) ';'
CPtr = '*' ('const' | 'volatile' | 'restrict' | CAttr)*
CDeclarator = CPtr* (CId | (| CAttr* CDeclarator |)) CSuffix* CAttr*
CSuffix = (| CParams? |) | (| CId % ',' |) | [| ('static' | 'const' | 'restrict')* (CAssign | '*')? |]
CParams = CParam % ',' (',' '...')?
CParam = CType (CDeclarator | CAbstract)?
CAbstract = CPtr+ CAbsSuffix* | CPtr* (| CAbstract |) CAbsSuffix* | CAbsSuffix+
CAbsSuffix = (| CParams? |) | [| ('static' | 'const' | 'restrict')* (CAssign | '*')? |]
CTypeName = CType CAbstract?
CDecl = CType ((CDeclarator ('asm' (| @any* |))? CAttr* ('=' CInit)?) % ',')? ';' | 'static_assert' (| CArgs |) ';' | 'id' (| @any* |) ';'?
CInit = CAssign | {| (CElement % ',' ','?)? |}
CElement = ((('.' CId) | [| CCond ('...' CCond)? |])+ '=')? CInit
CFunction = (CSpec* CType)? CPtr* (CId | (| CAttr* CDeclarator |)) ((| CParams? |) | (| CId % ',' |)) CSuffix* CAttr* CDecl* {| CItem* |}
CItem = CDecl | CStmt
CStmt = ';' | {| CItem* |} | CExpr ';' | 'if' (| CExpr |) CStmt ('else' CStmt)? | 'while' (| CExpr |) CStmt | 'do' CStmt 'while' (| CExpr |) ';' | 'for' (| CFor |) CStmt | 'switch' (| CExpr |) CStmt
  | 'case' CCond ('...' CCond)? ':' | 'default' ':' | CId ':' | 'return' CExpr? ';' | 'break' ';' | 'continue' ';' | 'goto' CId ';' | 'asm' ('volatile' | 'goto')* (| @any* |) ';'
CFor = (CExpr? ';' | CDecl) CExpr? ';' CExpr?
CExpr = CAssign % ','
CAssign = CCond | CUnary CAssignOp CAssign
CAssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>='
CCond = CBin ('?' CExpr? ':' CCond)?
CBin = CUnary (CBinOp CUnary)*
CBinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '+' | '-' | '*' | '/' | '%'
CUnary = ('+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | (| CTypeName |))* CPrimary | 'sizeof' (| CTypeName |) | 'sizeof' CUnary | ('+' | '-' | '!' | '~' | '*' | '&' | (| CTypeName |))+ 'sizeof' ((| CTypeName |) | CUnary) | 'alignof' (| CTypeName |)
CPrimary = CAtom CPost*
CAtom = CId | 'num' | 'str'+ | 'true' | 'false' | 'nullptr' | (| CExpr |) | (| {| CItem* |} |) | (| CTypeName |) {| (CElement % ',' ','?)? |}
CPost = [| CExpr |] | (| CArgs? |) | ('.' | '->') CId | '++' | '--'
CArgs = (CAssign | CTypeName) % ','
"""

JS = """
Unit = Tops
Tops = Top*
Top = Stmt0 | 'import' 'str' ImportAttrs? End | 'import' ImportClause 'from' 'str' ImportAttrs? End | Export
ImportAttrs = ('with' | 'assert') {| (Word ':' 'str') % ',' ','? |}
ImportClause = Id (',' (NsImport | NamedImports))? | NsImport | NamedImports
NsImport = '*' 'as' Id
NamedImports = {| (ImportSpec % ',' ','?)? |}
ImportSpec = (Word | 'str') ('as' (Word | 'str'))?
Export = 'export' (VarStmt | Func | Class) | 'export' 'default' (Func | Class | Expr End) | 'export' ('*' ('as' (Word | 'str'))? | NamedImports) ('from' 'str' ImportAttrs?)? End | 'export' Decorators Class
Word = @word
Id = 'id' | 'as' | 'from' | 'of' | 'get' | 'set' | 'async' | 'let' | 'static' | 'type' | 'target' | 'meta' | 'accessor' | 'declare' | 'abstract' | 'readonly' | 'namespace' | 'module' | 'is' | 'asserts' | 'infer' | 'keyof' | 'unique' | 'satisfies' | 'assert' | 'any' | 'unknown' | 'never' | 'override' | 'global' | 'out' | 'string' | 'number' | 'boolean' | 'symbol' | 'object' | 'bigint' | 'undefined'
End = ';' | $
Stmts = Stmt*
Block = {| Stmts |}
Stmt = ';' | Block | VarStmt | Func | Class | Decorators Class | Exprs End | 'if' (| Exprs |) Stmt ('else' Stmt)? | 'while' (| Exprs |) Stmt | 'do' Stmt 'while' (| Exprs |) ';'? | 'for' 'await'? (| ForHead |) Stmt
  | 'return' Exprs? End | 'throw' Exprs End | 'break' Id? End | 'continue' Id? End | 'debugger' End | 'try' Block (Catch Finally? | Finally) | 'switch' (| Exprs |) {| Cases |} | Id ':' Stmt
Cases = Case*
Catch = 'catch' (| Bind |) Block | 'catch' Block
Finally = 'finally' Block
Case = ('case' Exprs | 'default') ':' Stmts
VarStmt = ('var' | 'let') Binds End | ('const' | 'using' | 'await' 'using') Fixed End
Binds = (Id ('=' Expr)? | Bind '=' Expr) % ','
Fixed = (Bind '=' Expr) % ','
Bind = Id | [| PatList |] | {| (PatProp % ',' ','?)? |}
PatList = ','* (PatItem (','+ PatItem)*)? ','*
PatItem = '...'? Bind ('=' Expr)?
PatProp = '...' Id | PropName ':' PatItem | Id ('=' Expr)?
ForHead = ForInit? ';' Exprs? ';' Exprs? | (('var' | 'let' | 'const' | 'using') Bind | Post2) ('of' | 'in') Exprs
ForInit = ('var' | 'let') Binds | 'const' Fixed | Exprs
Post2 = Primary
Func = 'async'? 'function' '*'? Id? Sig Block
Sig = (| Params? |)
Params = Param % ',' ','?
Param = Decorators? '...'? Bind ('=' Expr)?
Class = 'class' Id? ('extends' Primary)? {| Members |}
Decorators = ('@' Primary)+
Members = Member*
Member = ';' | 'static' Block | Decorators? ('static' | 'accessor')* ('get' | 'set' | 'async')? '*'? PropName Sig Block | Decorators? ('static' | 'accessor')* PropName ('=' Expr)? End
PropName = Word | 'str' | 'num' | [| Expr |] | '#private'
Exprs = Expr % ','
Expr = Bin ('?' Expr ':' Expr)? | Place AssignOp Expr | Arrow | 'yield' '*'? Expr | 'yield'
Place = Id | Operand Post* (Member2 | [| Exprs |]) | [| Elements |] | {| (Prop % ',' ','?)? |} | (| Place |)
Member2 = '.' (Word | '#private')
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Arrow = 'async'? (Id | ArrowSig) '=>' (Expr | Block)
ArrowSig = Sig
Bin = Unary (BinOp Unary)* | '#private' 'in' Unary
BinOp = '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**' | 'in' | 'instanceof'
Unary = ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* Primary
Primary = Operand Post*
Operand = Id | 'num' | 'str' | 'tmpl' | 'regex' | 'this' | 'super' | 'null' | 'true' | 'false' | (| Exprs |) | [| Elements |] | {| (Prop % ',' ','?)? |} | Func | Class | 'new' '.' 'target' | New | 'import' (| Exprs ','? |) | 'import' '.' 'meta' | Decorators Class
New = 'new' Operand ('.' (Word | '#private') | [| Exprs |])* (| Args? |) | 'new' Operand ('.' (Word | '#private') | [| Exprs |])*
Elements = ','* (Element (','+ Element)*)? ','*
Element = '...'? Expr
Prop = '...' Expr | PropName ':' Expr | ('get' | 'set' | 'async')? '*'? PropName Sig Block | Id ('=' Expr)?
Post = '.' (Word | '#private') | '?.' (Word | '#private' | (| Args? |) | [| Exprs |] | 'tmpl') | (| Args? |) | [| Exprs |] | 'tmpl' | '++' | '--'
Args = ('...'? Expr) % ',' ','?
"""



def outside(rules: str, names: str, without: str) -> str:
    """The rules of the named symbols once more, as they hold outside of functions: under names of
    their own and without an alternative that only functions have."""
    wanted = "|".join(names.split())
    found = re.findall(rf"(?ms)^({wanted}) (\+?=) (.*?)(?=^\w+ \+?= |\Z)", rules)
    return "".join(f"{name}0 {op} {re.sub(rf'\b({wanted})\b', r'\g<1>0', body.replace(without, ''))}" for name, op, body in found)


OUTSIDE, RETURN = "Stmts Block Stmt Catch Finally Cases Case", "| 'return' Exprs? End "
TS = (
    JS
    + """
Top += 'import' 'type' ImportClause 'from' 'str' ImportAttrs? End | 'import' 'type'? Id '=' ('require' (| 'str' |) | Id ('.' Id)*) End | 'export' '=' Expr End | 'export' 'as' 'namespace' Id End
ImportSpec += 'type' (Word | 'str') ('as' (Word | 'str'))?
Export += 'export' TypeStmt | 'export' 'type' ('*' ('as' Word)? | NamedImports) ('from' 'str')? End | 'export' 'default' 'abstract' Class | 'export' 'default' Interface | 'export' 'import' Id '=' Id ('.' Id)* End
Stmt += TypeStmt | 'abstract' Class
TypeStmt = 'type' Id TypeParams? '=' Type End | Interface | 'const'? 'enum' Id {| (((Word | 'str' | [| 'str' |]) ('=' Expr)?) % ',' ','?)? |} | ('namespace' | 'module') (Id ('.' Id)* | 'str') {| Tops |} | 'declare' (TypeStmt | Declared | Func2 | 'abstract'? Class | 'global' {| Ambient |} | ('namespace' | 'module') (Id ('.' Id)* | 'str') {| Ambient |} | 'module' 'str' End) | Func2 | 'abstract' Class
Ambient = (Top | 'export'? Declared)*
Func2 = 'async'? 'function' '*'? Id? Sig End
Interface = 'interface' Id TypeParams? ('extends' Type % ',')? {| TypeMembers |}
TypeMembers = TypeMember*
TypeMember = ';' | ',' | TypeMemberBody (';' | ',' | $)
TypeMemberBody = 'new'? Sig | ('get' | 'set')? PropName '?'? Sig | ('+' | '-')? 'readonly'? PropName '?'? (':' Type)? | 'readonly'? [| Id ':' Type |] ':' Type | (('+' | '-')? 'readonly')? [| Id 'in' Type ('as' Type)? |] (('+' | '-')? '?')? (':' Type)?
TypeParams = '<' (('const' | 'in' | 'out')* Id ('extends' Type)? ('=' Type)?) % ',' ','? '>'
TypeArgs = '<' Type % ',' ','? '>'
Type = ('|' | '&')? TypeOne (('|' | '&') TypeOne)* | TypeOne 'extends' Type '?' Type ':' Type | TypeParams? (| Params? |) '=>' Type | 'abstract'? 'new' TypeParams? (| Params? |) '=>' Type | 'asserts' (Id | 'this') ('is' Type)? | (Id | 'this') 'is' Type | ('|' | '&') Type
TypeOne = ('keyof' | 'unique' | 'readonly' | 'infer')* TypeAtom ([| Type? |])* | 'infer' Id 'extends' Type
TypeAtom = TypeName TypeArgs? | 'typeof' (Id | 'this' | 'import' (| 'str' |)) ('.' (Word | '#private'))* TypeArgs? | 'import' (| 'str' |) ('.' Word)* TypeArgs? | 'void' | 'null' | 'this' | 'true' | 'false' | 'str' | 'tmpl' | '-'? 'num' | {| TypeMembers |} | [| ((TupleItem) % ',' ','?)? |] | (| Type |)
TypeName = Id ('.' Word)*
TupleItem = '...'? (Word '?'? ':')? Type '?'?
Binds += (Id '!'? (':' Type)? ('=' Expr)? | Bind (':' Type)? '=' Expr) % ','
Fixed += (Bind (':' Type)? '=' Expr) % ','
Declared = ('var' | 'let' | 'const') (Bind (':' Type)? ('=' Expr)?) % ',' End
Place += Operand Post* '!' | '<' Type '>' Place | (| Place 'as' Type |)
Param += Decorators? ('public' | 'private' | 'protected' | 'readonly' | 'override')* '...'? (Bind | 'this') '?'? (':' Type)? ('=' Expr)?
Sig += TypeParams? (| Params? |) (':' Type)?
ArrowSig += TypeParams? (| Params? |) (':' Type)?
Catch += 'catch' (| Bind ':' Type |) Block
Class += 'class' Id? TypeParams? ('extends' Primary TypeArgs?)? ('implements' Type % ',')? {| Members |}
Member += Decorators? MemberMod* ('get' | 'set' | 'async')? '*'? PropName ('?' | '!')? Sig (Block | End) | Decorators? MemberMod* PropName ('?' | '!')? (':' Type)? ('=' Expr)? End | MemberMod* [| Id ':' Type |] ':' Type End
MemberMod = 'static' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
Prop += ('get' | 'set' | 'async')? '*'? PropName '?'? Sig Block
Post += '!' | TypeArgs | 'as' (Type | 'const') | 'satisfies' Type
Unary += '<' (Type | 'const') '>' Unary
"""
)
TS += outside(TS, OUTSIDE, RETURN)
JS += outside(JS, OUTSIDE, RETURN)
#: Markup inside of expressions: the lexer checks the tags and hands on what stands in braces.
MARKUP = """
Operand += Markup
Markup = '<markup' (Markup | {| ('...'? Expr)? |})* 'markup>'
"""
JSX = JS + MARKUP
TSX = TS.replace("Unary += '<' (Type | 'const') '>' Unary\n", "").replace(" | '<' Type '>' Place", "") + MARKUP

#: Functions by themselves: marks before the signature, what stands before the name, the name, and
#: what follows it. The loose tail takes any body in a block.
PYTHON += """
Function = FunctionMarks FunctionHead FunctionName FunctionTail
FunctionMarks = Decorator*
FunctionHead = 'async'? 'def'
FunctionName = Name
FunctionTail = TypeParams? (| Params? |) ('->' Test)? ':' Suite
FunctionLoose = @flat* 'nl' <| @any* |> | @flat* 'nl'
"""
BLOCK_LOOSE = "(| @any* |) @flat* ({| @any* |} | ';')\n"
GO += """
Function = FunctionMarks FunctionHead FunctionName FunctionTail
FunctionMarks = ';'*
FunctionHead = 'func' (| Params? |)?
FunctionName = 'id'
FunctionTail = TypeParams? Sig Body?
FunctionLoose = """ + BLOCK_LOOSE
JAVA += """
Method = MethodMarks MethodHead MethodName MethodTail
MethodMarks = Annot*
MethodHead = Mod* TypeParams? Annot* Type?
MethodName = Id
MethodTail = (| Params? |) Dims? ('throws' Types)? (Block | ';' | 'default' ElemValue ';') | Block
MethodLoose = """ + BLOCK_LOOSE
RUST += """
Function = FunctionMarks FunctionHead FunctionName FunctionTail
FunctionMarks = Attr*
FunctionHead = Vis? FnQual* 'fn'
FunctionName = 'id'
FunctionTail = Generics? (| FnParams? |) ('->' Type)? Where? (Block | ';')
FunctionLoose = @flat* ({| @any* |} | ';')
"""
CPP += """
Method = MethodMarks MethodHead MethodName MethodTail
MethodMarks = ('template' '<' (TParam % ',')? '>' Requires?)* Attrs*
MethodHead = Specs? Ptr* | Spec*
MethodName = Name
MethodTail = (| Params? |) Quals (FuncBody | ';' | '=' 'num' ';')
MethodLoose = """ + BLOCK_LOOSE
C += """
Method = MethodMarks MethodHead MethodName MethodTail
MethodMarks = CAttr*
MethodHead = CSpec* CType CPtr*
MethodName = CId
MethodTail = (| CParams? |) CDecl* ({| CItem* |} | ';')
MethodLoose = """ + BLOCK_LOOSE
SCRIPT = """
Function = FunctionMarks FunctionHead FunctionName FunctionTail
FunctionMarks = Decorators?
FunctionHead = ('export' 'default'?)? 'async'? 'function' '*'? | 'export'? ('const' | 'let' | 'var')
FunctionName = Id
FunctionTail = Sig (Block | End) | '=' Arrow End? | '=' 'async'? 'function' '*'? Id? Sig Block End?
FunctionLoose = @flat* {| @any* |}
Method = MethodMarks MethodHead MethodName MethodTail
MethodMarks = Decorators?
MethodHead = ('static' | 'accessor')* ('get' | 'set' | 'async')? '*'?
MethodName = PropName
MethodTail = Sig Block | '=' Arrow End?
MethodLoose = (| @any* |) @flat* {| @any* |}
"""
JS, JSX = JS + SCRIPT, JSX + SCRIPT
TYPED = SCRIPT + """
FunctionHead += 'declare' 'async'? 'function' '*'? | 'export' 'declare' 'function'
FunctionTail += ':' Type '=' Arrow End?
MethodHead += MemberMod* ('get' | 'set' | 'async')? '*'?
MethodTail += ('?' | '!')? Sig (Block | End) | ':' Type '=' Arrow End?
"""
TS, TSX = TS + TYPED, TSX + TYPED
