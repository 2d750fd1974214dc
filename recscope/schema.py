"""The trace model: fixed values, record layout and the columns of its tables.

Tables (each a DataFrame): ``fragments`` has a row for each 64-byte slot of a journal; ``dumps`` and ``chunks`` are
its headers; ``processes``, ``log_descriptors`` and ``enum_values`` are the dimensions decoded from its metadata; ``records``
has a row for each log record, re-assembled and joined with the dimensions. A record's place is
``ORDER_KEY``: dumps stay in file order, within a dump time decides, then the chunk, then the slot.
"""

from __future__ import annotations

# Fixed values of the format.
SEVERITIES = {"INVALID": 0, "FUNC_TRACE": 1, "DEBUG": 2, "INFO": 3, "WARN": 4, "ERROR": 5, "FATAL": 6}
KINDS = {"FUNC_ENTRY": 0, "FUNC_LEAVE": 1, "EXPLICIT": 2}
REC_TYPES = {"UNKNOWN": 0, "TYPED": 1, "FILE_HEADER": 2, "METADATA_HEADER": 3, "METADATA_PAYLOAD": 4, "DUMP_HEADER": 5, "BUFFER_CHUNK": 6, "END_OF_FILE": 7}
LAST, FIRST = 1, 2
FLAGS = {
    "NUM_8": 0x001,
    "NUM_16": 0x002,
    "NUM_32": 0x004,
    "NUM_64": 0x008,
    "VARRAY": 0x010,
    "CSTR": 0x020,
    "STR": 0x040,
    "BLOB": 0x080,
    "UNSIGNED": 0x100,
    "HEX": 0x200,
    "ZERO": 0x400,
    "ENUM": 0x800,
    "NESTED_LOG": 0x1000,
    "ENTER": 0x2000,
    "LEAVE": 0x4000,
    "TYPEDEF": 0x8000,
    "NAMED_PARAM": 0x10000,
    "RECORD": 0x20000,
    "DOUBLE": 0x40000,
}
#: Severities that a reader shows unless it is told otherwise.
DEFAULT_SEVERITIES = ("INFO", "WARN", "ERROR", "FATAL")
SLOT = 64

FRAGMENTS = "file string, pos bigint, ts_ns bigint, pid int, tid int, nesting int, termination int, severity int, rec_type int, generation bigint, payload binary"
PARAM = "struct<flags:bigint,type_id:bigint,param_name:string,text:string,type_name:string>"
DESCRIPTORS = f"log_id bigint, kind int, severity int, params array<{PARAM}>"
#: One decoded value: ``i`` as displayed, ``u`` zero-extended as filters compare it, ``s`` text or enumerator, ``b`` bytes.
VALUE = "struct<idx:int,depth:int,name:string,kind:string,flags:bigint,i:bigint,u:decimal(20,0),d:double,s:string,b:binary,type_name:string>"
ORDER_KEY = ("file", "dump_pos", "ts_ns", "chunk_idx", "pos")


def severity_number(name: str | int) -> int:
    """The number of a severity; unknown names are an error."""
    if isinstance(name, int):
        return name
    if name not in SEVERITIES:
        raise ValueError(f"unknown severity {name!r}; one of {', '.join(SEVERITIES)}")
    return SEVERITIES[name]
