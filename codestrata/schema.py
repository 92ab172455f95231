"""Schemas of parsed units."""

FUNCTION = "struct<ord:int,name:string,enclosing:string,start_line:int,end_line:int,complexity:int,cognitive:int,length:int,nesting:int,params:int,bool_max:int,calls:array<string>,anonymous:boolean>"
UNIT = (
    "path string, lang string, class string, package string, import_path string, total_lines int, physical_sloc int, logical_loc int, comment_lines int, is_generated boolean, "
    f"functions array<{FUNCTION}>, types array<struct<name:string,abstract:boolean>>, imports array<string>, toks array<string>, tok_lines array<int>, error string"
)
