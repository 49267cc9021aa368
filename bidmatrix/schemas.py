"""Table layouts, input document layouts and the fixed default values of both intake lanes."""

# One row per quote and one row per priced line. Money is whole cents (bigint).
QUOTES = (
    "quote_id string, session_id string, vendor_name string, client_name string, "
    "quote_date string, grand_total_cents bigint, source_filename string, source_type string"
)
QUOTE_ITEMS = (
    "quote_id string, session_id string, item_no int, service_category string, "
    "sub_service string, work_title string, description string, quantity double, "
    "pricing_method string, rate_cents bigint, amount_cents bigint"
)
QUARANTINE = (
    "quote_id string, session_id string, source_filename string, source_type string, "
    "document string, defects array<string>"
)
CELLS = (
    "session_id string, service_category string, sub_service string, vendor string, "
    "amount_cents bigint"
)

# Input documents. Leaves are VARIANT because an absent key takes a default while an explicit
# JSON null stays null, and from_json with typed leaves cannot tell the two apart.
MARKET_QUOTE = (
    "quoteNumber:variant,vendorDetail:variant,"
    "pricingSummary:array<struct<label:variant,value:variant>>,"
    "workSummary:array<struct<services:array<struct<serviceId:variant,"
    "workItems:array<struct<workTitle:variant,description:variant,subService:variant,"
    "pricingMethod:variant,pricingInput:array<struct<quantity:variant,rate:variant,"
    "grandTotal:variant>>>>>>>>"
)
MARKET_WORK = MARKET_QUOTE[MARKET_QUOTE.index("workSummary"):]
EXTRACTED_QUOTE = (
    "vendor_name variant, client_name variant, quote_date variant, grand_total variant, "
    "services array<struct<service_category:variant,items:array<struct<sub_service:variant,"
    "work_title:variant,description:variant,quantity:variant,pricing_method:variant,"
    "rate:variant,amount:variant>>>>"
)

# The same documents with their lines' leaves read at once. A leaf that is not null here was there, was no
# explicit null and reads as its type, so only quotes with a null need the layouts above.
PLAIN_MARKET_QUOTE = (
    "quoteNumber:variant,vendorDetail:variant,"
    "pricingSummary:array<struct<label:variant,value:variant>>,"
    "workSummary:array<struct<services:array<struct<serviceId:struct<name:string>,"
    "workItems:array<struct<workTitle:string,description:string,subService:struct<name:string>,"
    "pricingMethod:struct<name:string>,pricingInput:array<struct<quantity:string,rate:decimal(38,20),"
    "grandTotal:string>>>>>>>>"
)
PLAIN_EXTRACTED_QUOTE = (
    "vendor_name:variant,client_name:variant,quote_date:variant,grand_total:variant,"
    "services:array<struct<service_category:string,items:array<struct<sub_service:string,"
    "work_title:string,description:string,quantity:string,pricing_method:string,"
    "rate:decimal(38,20),amount:decimal(38,20)>>>>"
)

# What an absent key becomes, structured push lane.
PUSH_DEFAULTS = {
    "vendor_name": "Unknown Vendor",
    "source_filename": "DIRECT_SYNC",
    "source_type": "mongodb_integrated",
    "service_category": "General",
    "sub_service": "General Service",
    "work_title": "",
    "description": "",
    "pricing_method": "Unit",
}
# What an absent key becomes, extracted-document lane.
DOCUMENT_DEFAULTS = {
    "vendor_name": "Unknown",
    "client_name": "Unknown",
    "quote_date": "",
    "service_category": "General",
    "sub_service": "Unknown",
    "work_title": "",
    "description": "",
    "pricing_method": "",
}

SESSION = ["session_id"]
SERVICE = ["service_category", "sub_service"]
ROW = SESSION + SERVICE
