"""Data model: explicit schemas, bounds and fixed formats. Nothing is inferred."""

from __future__ import annotations

import os
from decimal import Decimal

# Bounds of the data model, in bytes where they are sizes.
MAX_RECORDS = 20_000
MAX_KEYS = 32
MAX_TITLE, MAX_SNIPPET = 200, 500
MAX_TAGS, MAX_TAG = 16, 40
MAX_APPS, MAX_APP_SLUG, MAX_APP_NAME = 64, 32, 64
MAX_TEMPLATE, MAX_RESOURCE = 128, 64
MAX_URL, MAX_PATH, MAX_VOCAB = 512, 512, 16
MAX_EXT_KEYS, MAX_EXT_KEY, MAX_EXT_BYTES = 8, 32, 64
MAX_DECODE_PASSES = 8
MAX_VERSION = Decimal(2**64 - 1)
MAX_RECONCILE_AGE = 2400
MIN_DESCRIBABLE = 200

# Formats.
#: A deployment names the URI scheme of its contracts, and the name that their locators have in documents.
CONTRACT_SCHEME = os.environ.get("TIDEMARK_CONTRACT_SCHEME", "contract")
CONTRACT_VARIANT = os.environ.get("TIDEMARK_CONTRACT_VARIANT", "Contract")
WEB_PREFIX = "/v1/contract/web/"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

BASE58_RUN = "[1-9A-HJ-NP-Za-km-z]"
U64 = "decimal(20,0)"

LOCATOR = "struct<variant:string,contract_id:string,url:string,app:string,resource:string,path:string>"
CLASS = f"struct<landing:string,has_adult_sections:boolean,volatility:string,classifier:int,classified_at:{U64}>"
VERIFIED = f"struct<last_verified_at:{U64},status:string>"
ENTRY = f"struct<kind:string,title:string,snippet:string,tags:array<string>,locator:{LOCATOR},featured:boolean,added_at:{U64},class:{CLASS},verified:{VERIFIED},ext:map<string,string>>"
RECORDS = f"subject_id string, version {U64}, is_tomb boolean, entry {ENTRY}, by binary, sig binary"
KEY_AUTH = f"version {U64}, authorized array<binary>, sig binary"
REGISTRY = f"index_slug string, version {U64}, apps map<string,struct<contract_id:string,name:string,link_template:string>>, sig binary"
APPS = "app string, contract_id string, name string, link_template string"
SUMMARY = f"subject_id string, version {U64}, fp binary"
