from plover.plans.report import main

raise SystemExit(main())
